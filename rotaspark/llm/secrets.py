"""Secret scans that link the parts of a credential: access identifiers, secrets and endpoints.

Strong parts stand for themselves. Weak ones (a login, a short or opaque value, an address) are everywhere in plain
text and count only beside their complements: an interval join over the parts of one scope, a block of text between
blank lines, finds which roles lie within REACH code points. Everything is DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotaspark.llm.common import staged

#: Code points between the starts of two parts of one credential.
REACH = 200
IDENTIFIER, SECRET, ENDPOINT = 1, 2, 3
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _keys(words: str) -> str:
    """A pattern for some words, each letter in either case; `_?` is an optional underscore."""
    return "".join(f"[{c}{c.upper()}]" if c in _LETTERS else c for c in words)


_GIVEN = "[\"']?\\x20*[:=]\\x20*[\"']?"


@dataclass(frozen=True)
class Kind:
    """A pattern with one group for its value, its role in a credential, and which spans hide it where they overlap.

    A base kind is strong and always reported. `fails_to` names the kind of matches whose value is shorter than least.
    """

    name: str
    pattern: str
    role: int
    base: bool = False
    least: int = 1
    fails_to: str | None = None
    mixed: bool = False


#: In the order of spans with equal starts. The patterns mean the same to Java's and to RE2's matcher; repeats are bounded
#: where a matcher that goes back would take the square of an unbroken text, or a call for each of its labels.
KINDS = (
    Kind("assign", _keys("(?:password|passwd|secret|token|api_?key)") + _GIVEN + "([A-Za-z0-9+/_.=-]+)", SECRET, True, 6, "short"),
    Kind("access", "(AKIA[A-Z0-9]{16,})", IDENTIFIER, True),
    Kind("hex", "([0-9a-f]{24,})", SECRET, True),
    Kind("login", _keys("(?:user(?:_?name|_?id)?|login|account(?:_?id)?|client_?id|access_?key_?id)") + _GIVEN + "([A-Za-z0-9@._+-]+)", IDENTIFIER, least=3),
    Kind("email", "([A-Za-z0-9._+-]{1,64}@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+){1,20})", IDENTIFIER),
    Kind("short", "", SECRET),
    Kind("loose", _keys("(?:pwd|pass|passphrase|credentials?|private_?key|access_?key|auth)") + _GIVEN + "([A-Za-z0-9+/_.=-]+)", SECRET, least=4),
    Kind("opaque", "([A-Za-z0-9+/_=-]{20,})", SECRET, mixed=True),
    Kind("url", "((?:https?|ftps?|sftp|ssh|s3|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\\x00-\\x20\"'<>\\x7F]+)", ENDPOINT),
    Kind("host", _keys("(?:host(?:_?name)?|endpoint|server)") + _GIVEN + "([A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+){1,20})", ENDPOINT),
)
NUMBER = {k.name: i for i, k in enumerate(KINDS)}
#: A blank line ends a scope.
BREAK_PATTERN = "\\n[\\x20\\t\\r]*\\n"
_BREAK = len(KINDS)
_HIT = "array<struct<source: int, kind: int, n: int, before: int, size: int>>"


def _hits(text: Column, number: int, kind: Kind) -> Column:
    """The matches of a kind in order, with the code points before each (since the match before it) and its own."""
    whole, value = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(1))
    rows = F.arrays_zip(F.split(text, kind.pattern, -1).alias("before"), whole.alias("whole"), value.alias("value"))

    def hit(x: Column, i: Column) -> Column:
        good = F.length(x["value"]) >= kind.least
        if kind.mixed:
            good = good & x["whole"].rlike("[a-z]") & x["whole"].rlike("[A-Z]") & x["whole"].rlike("[0-9]")
        other = NUMBER[kind.fails_to] if kind.fails_to else -1
        return F.struct(
            F.lit(number).alias("source"), F.when(good, number).otherwise(other).alias("kind"), i.alias("n"),
            F.length(x["before"]).alias("before"), F.length(x["whole"]).alias("size"),
        )

    found = F.filter(F.transform(rows, hit), lambda x: x["size"].isNotNull())
    return F.when(text.rlike(kind.pattern), found).otherwise(F.array().cast(_HIT))


def found_parts(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, found) of every row of docs: the matches of all kinds, and the breaks of texts with a match.

    Matches hold no line feed, so those of the base kinds are the same whether a text is read whole or by scopes. The
    source of a match is its kind's place in KINDS, also where it fails to another kind.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("mark"), text.alias("text"))
    every = [_hits(F.col("text"), i, k) for i, k in enumerate(KINDS) if k.pattern]
    rows = rows.withColumn("parts", F.concat(*every))
    breaks = _hits(F.col("text"), _BREAK, Kind("break", f"({BREAK_PATTERN})", 0))
    return rows.select("doc_id", "mark", F.when(F.size("parts") > 0, F.concat("parts", breaks)).otherwise(F.col("parts")).alias("found"))


def spans_of(found: DataFrame) -> DataFrame:
    """(doc_id, mark, scope, kind, start, end) of the parts, once for each doc_id and text.

    Positions are running sums over the matches of one pattern in one text. Weak parts that overlap others drop out: all
    but urls and hosts where a base part lies over them, opaque values where any other part does.
    """
    hits = found.where(F.size("found") > 0).dropDuplicates(["doc_id", "mark"]).select("doc_id", "mark", F.explode("found").alias("h"))
    hits = hits.select("doc_id", "mark", "h.*").repartition("doc_id", "mark")
    run = Window.partitionBy("doc_id", "mark", "source").orderBy("n")
    ends = F.sum(F.col("before") + F.col("size")).over(run)
    rows = hits.withColumn("end", ends.cast("int")).withColumn("start", F.col("end") - F.col("size")).where("kind >= 0")
    text = Window.partitionBy("doc_id", "mark")
    ahead, back = text.orderBy("start"), text.orderBy(F.desc("start"))
    base = F.col("kind").isin([i for i, k in enumerate(KINDS) if k.base])
    solid = ~F.col("kind").isin(NUMBER["opaque"], _BREAK)
    rows = rows.select(
        "*",
        F.count(F.when(F.col("kind") == _BREAK, 1)).over(ahead).alias("scope"),
        F.max(F.when(base, F.col("end"))).over(ahead).alias("base_end"),
        F.max(F.when(solid, F.col("end"))).over(ahead).alias("solid_end"),
        F.min(F.when(base, F.col("start"))).over(back).alias("base_start"),
        F.min(F.when(solid, F.col("start"))).over(back).alias("solid_start"),
    )
    over = lambda a, b: F.coalesce(F.col(a) > F.col("start"), F.lit(False)) | F.coalesce(F.col(b) < F.col("end"), F.lit(False))
    hidden = F.when(base | F.col("kind").isin(NUMBER["url"], NUMBER["host"]), False)
    hidden = hidden.when(F.col("kind") == NUMBER["opaque"], over("solid_end", "solid_start")).otherwise(over("base_end", "base_start"))
    return rows.where((F.col("kind") != _BREAK) & ~hidden).select("doc_id", "mark", "scope", "kind", "start", "end")


def _by_kind(values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.col("kind") + 1)


def linked(spans: DataFrame, reach: int = REACH) -> DataFrame:
    """The spans that are reported: all base ones, and weak ones whose complements lie within reach in their scope.

    Complements are parts of the other two roles. A strong one is enough; of weak ones, both roles must be there. Parts
    are first brought to their first and last start per cell of reach code points, role and strength; a part of the
    same cell is always near, one of a neighbouring cell is if the nearest start is. So the join sees a few rows per
    cell, whatever the number of parts, and never pairs.
    """
    parts = spans.select(
        "*", _by_kind([k.role for k in KINDS]).alias("role"), _by_kind([k.base for k in KINDS]).alias("base"),
        F.expr(f"start div {reach}").alias("cell"),
    )
    place = ["doc_id", "mark", "scope", "cell"]
    cells = parts.groupBy(*place, "role", "base").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    weak = parts.where(~F.col("base")).withColumn("side", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    weak = weak.withColumn("cell", F.col("cell") + F.col("side")).alias("w")
    cells = cells.alias("c")
    same = F.lit(True)
    for name in place:
        same = same & F.col(f"w.{name}").eqNullSafe(F.col(f"c.{name}"))
    distance = F.when(F.col("w.side") < 0, F.col("w.start") - F.col("c.last")).when(F.col("w.side") > 0, F.col("c.first") - F.col("w.start")).otherwise(0)
    near = weak.join(cells, same & (F.col("w.role") != F.col("c.role"))).where(distance <= reach)
    near = near.groupBy(*[f"w.{c}" for c in spans.columns]).agg(
        F.max("c.base").alias("strong"), F.count_distinct("c.role").alias("roles")
    )
    return parts.where("base").select(*spans.columns).unionByName(near.where("strong OR roles = 2").select(*spans.columns))


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, spans) of every row of docs; spans: array of (start, number, kind, end, base) by start, then kind.

    Positions are code points from 0, the end exclusive. A NULL or empty text has no spans; rows with NULL ids are
    judged by their text; repeated rows are repeated; columns besides doc_id and text are ignored, whatever their names,
    and an empty table gives no rows. Texts are read once; later steps see matches only.
    """
    found = staged(found_parts(docs), "secret-parts")
    name, base = _by_kind([k.name for k in KINDS]), _by_kind([k.base for k in KINDS])
    span = F.struct("start", F.col("kind").alias("number"), name.alias("kind"), "end", base.alias("base"))
    spans = linked(spans_of(found), reach).groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    rows, spans = found.select("doc_id", "mark").alias("r"), spans.alias("s")
    same = F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r.mark") == F.col("s.mark"))
    empty = F.array().cast(spans.schema["spans"].dataType)
    return rows.join(spans, same, "left").select("r.doc_id", F.coalesce("s.spans", empty).alias("spans"))
