"""Quality rules, line dedup and mixing against plain Python versions."""

import collections
import random
import re
import time
from bisect import bisect_left

import pytest

from rotaspark.llm import line_dedup, mixing, quality_rules
from rotaspark.llm.common import successors

from .support import documents, empty, prose, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


def test_base_measures(spark):
    docs = documents(spark, extra="words")
    for r in quality_rules.base_measures(docs).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words)
        assert got == measured(r.text), r.doc_id
        assert r.words is None or isinstance(r.words, str)


def limit_of(weights, width):
    """Median and limit from a plain table of weights per value."""
    bins, total, run = sorted(weights), sum(weights.values()), 0
    share = [(run := run + weights[b]) * 10**9 // total for b in bins]
    first = bisect_left(share, 500_000_000)
    for k in range(first, len(bins)):
        beyond = [bins[j] for j in range(len(bins)) if share[j] >= share[k] + 2_000_000]
        if not beyond:
            return bins[first], bins[k] + width
        if min(beyond) - bins[k] >= width:
            return bins[first], (bins[k] + min(beyond)) // 2


def verdicts(rows):
    """The adaptive rules again, from exact lists of bins."""
    scale, group, lang = quality_rules.SCALE, collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)

    def metrics(m):
        n_words, chars, symbols, lines, dup, repeat = m
        return dict(zip(quality_rules.METRICS, (symbols * scale // n_words, dup * scale // lines, repeat * scale // n_words, chars * scale // n_words)))

    def low(v):
        drop = max(v.bit_length() - 6, 0)
        return v >> drop << drop

    found = [(r, m, m[0] < 50 or 100 * m[5] > 50 * m[0]) for r in rows for m in [measured(r.text)]]
    for r, m, failed in found:
        if not failed:
            for k, v in metrics(m).items():
                group[r.lang, r.source, k][low(v)] += 1
                lang[r.lang, k][low(v)] += 1
    tops = {}
    for (a, b, k), own in group.items():
        whole, width = lang[a, k], round(quality_rules.WIDTH[k] * scale)
        mixed = collections.Counter({x: n * sum(whole.values()) for x, n in own.items()})
        mixed.update({x: 100 * n for x, n in whole.items()})
        (centre, top), (mid, most) = limit_of(mixed, width), limit_of(whole, width)
        tops[a, b, k] = min(top, centre + 2 * (most - mid))
    out = []
    for r, m, failed in found:
        kept = not failed and all(v <= tops[r.lang, r.source, k] for k, v in metrics(m).items())
        out.append((r.doc_id is None, r.doc_id or 0, m[0], failed, kept))
    return sorted(out)


def test_quality_verdicts(spark):
    docs = documents(spark, extra="kept")
    got = [(r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["base_failed"], r["kept"]) for r in rows_of(quality_rules.judged(docs))]
    assert sorted(got) == verdicts(docs.collect())
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(x[-1] for x in got)
    assert quality_rules.judged(empty(docs)).count() == 0 and quality_rules.kept_documents(empty(docs)).count() == 0


JUNK = {
    "symbols": lambda words: [f"{w}$$" if i % (2 + len(words) % 5) else w for i, w in enumerate(words)],
    "dup_lines": lambda words: words + ["\nsame line here\n"] * 12,
    "repeats": lambda words: words + words[: int(0.3 * len(words))],
    "long_words": lambda words: [w * 2 for w in words],
}


@pytest.mark.parametrize("everywhere", [False, True])
def test_junk_of_each_metric_goes_and_clean_rows_stay(spark, everywhere):
    """10, 20 and 30% junk, a kind per language, in single sources (one with a third of all rows) or in all of them."""
    rng, rows = random.Random(4), []
    shares = {"a": (300, 0.3), "b": (100, 0.2), "c": (100, 0.1), "d": (250, 0), "e": (150, 0), "f": (3, 0)}
    for lang, kind in zip(("en", "de", "fr", "es"), JUNK):
        for source, (n, share) in shares.items():
            for i in range(n):
                words = prose(rng, rng.randint(80, 200)).split(" ")
                junk = i < (0.3 if everywhere else share) * n
                rows.append((len(rows), " ".join(JUNK[kind](words) if junk else words), lang, source, 1, "junk" if junk else "clean"))
    docs = spark.createDataFrame(rows, documents(spark, extra="kind").schema)
    kept = {r.doc_id for r in quality_rules.kept_documents(docs).collect()}
    for lang in ("en", "de", "fr", "es"):
        clean = {r[0] for r in rows if r[5] == "clean" and r[2] == lang}
        assert not kept & {r[0] for r in rows if r[5] == "junk" and r[2] == lang}
        assert len(clean & kept) >= 0.98 * len(clean)


def test_limits_follow_the_sources(spark):
    """A source whose documents all carry symbols keeps them; the same rate is junk in another source."""
    rng, rows = random.Random(5), []
    for source, rate in (("tables", 0.5), ("prose", 0), ("more", 0), ("mixed", None)):
        for i in range(200):
            words = prose(rng, 100).split(" ")
            share = (0.5 if i < 20 else 0) if rate is None else rate
            words = [w + "|" if rng.random() < share else w for w in words]
            rows.append((len(rows), " ".join(words), "en", source, 1, source if rate is not None or i >= 20 else "junk"))
    docs = spark.createDataFrame(rows, documents(spark, extra="kind").schema)
    lost = collections.Counter(r[5] for r in rows) - collections.Counter(r.kind for r in quality_rules.kept_documents(docs).collect())
    assert lost == {"junk": 20}
    sketch = quality_rules.sketch(quality_rules._measured(docs), ["lang_key", "source_key"])
    limits = {r.source_key: r.max_symbols for r in quality_rules.thresholds(sketch).collect()}
    assert limits["stables"] > 5000 > 3000 > limits["sprose"] and len(set(limits.values())) > 2


def test_sketches_merge(spark):
    measures = quality_rules.base_measures(documents(spark)).withColumnsRenamed({"lang": "lang_key"})
    whole = {(r.metric, r.bin): r.n for r in quality_rules.sketch(measures, []).collect()}
    parts = collections.Counter()
    for r in quality_rules.sketch(measures, ["source"]).collect():
        parts[r.metric, r.bin] += r.n
    assert whole == dict(parts)


def deduped(rows, least=5):
    def key(x):
        x = x.strip(" \t\n\x0b\f\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in x)

    holders = collections.defaultdict(set)
    for r in rows:
        for line in (r.text or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(r.doc_id)
    out = []
    for r in rows:
        lines = (r.text or "").split("\n")
        last = {k: max((i for i in h if i is not None), default=None) for k, h in holders.items() if len(h) >= least}
        kept = [x for x in lines if key(x) not in last or last[key(x)] == r.doc_id]
        out.append((r.doc_id is None, r.doc_id or 0, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup(spark):
    base = documents(spark, extra="n_lines")
    shared = "a line that several documents share, long enough to count"
    more = [(200 + i, f"x\n {shared.upper() if i % 2 else shared}\t\nown {i}\n{shared}", "en", "a", 1, "x") for i in range(5)]
    more += [(300 + i, f"only four share this line of more than forty chars\n{i}", "en", "a", 1, "x") for i in range(4)]
    more += [(204, more[4][1], "en", "a", 1, "x"), (None, shared, "en", "a", 1, "x"), (200, shared + "\nsecond text", "en", "a", 1, "x")]
    docs = base.union(spark.createDataFrame(more, base.schema))
    got = line_dedup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_dropped"]
    rows = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_lines"], r["n_dropped"], r["text"] or "") for r in rows_of(got))
    assert rows == deduped(docs.collect())
    assert sum(r[3] for r in rows) > 8
    assert line_dedup.dedup_lines(empty(docs)).count() == 0


def test_texts_of_many_lines(spark):
    """100,000 lines of which every third is lost: the rebuild is linear in the lines."""
    shared = "a line that several documents share, long enough to count"
    text = "\n".join(shared if i % 3 == 0 else f"line {i}" for i in range(100_000))
    rows = [(1, text, "en", "a", 1, "x"), *[(i, shared, "en", "a", 1, "x") for i in range(2, 8)]]
    docs = spark.createDataFrame(rows, documents(spark).schema)
    line_dedup.dedup_lines(docs.where("doc_id > 1")).collect()
    began = time.time()
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert time.time() - began < 10
    assert (got[1].n_lines, got[1].n_dropped) == (100_000, 33_334)
    assert got[1].text == "\n".join(f"line {i}" for i in range(100_000) if i % 3)
    assert got[7].text == shared and got[6].text == ""


def shared_out(sizes, weights, budget):
    """Targets by resharing the excess again and again."""
    target, open_ = {}, dict(zip(sizes, weights))
    left = budget
    while open_:
        level = left / sum(open_.values())
        full = [s for s, w in open_.items() if w * level > 2 * sizes[s]]
        if not full:
            return target | {s: w * level for s, w in open_.items()}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            del open_[s]
    return target


def test_mixture(spark):
    docs = documents(spark, extra="size")
    plan = mixing.mixture(docs).collect()
    assert {(r.doc_id, r.size, r.n_rows) for r in plan if r.n_rows > 1} == {(5, len(WORD.findall(next(d.text for d in docs.collect() if d.doc_id == 5))), 2)}
    sizes = collections.Counter()
    for d in docs.collect():
        sizes[d.source] += len(WORD.findall(d.text or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = shared_out({s: sizes[s] for s in order}, [3, 1, 2, 3], 1.5 * sum(sizes.values()))
    taken, longest = collections.Counter(), collections.Counter()
    for r in plan:
        s = None if r.key == "n" else r.key[1:]
        assert abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] and r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken * r.n_rows
        longest[s] = max(longest[s], r.size * r.n_rows)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    assert all(abs(taken[s] - want[s]) <= longest[s] + 1 for s in order)
    assert sorted(map(str, mixing.mixture(docs.repartition(3)).collect())) == sorted(map(str, plan))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(r.text)) for r in mixed.collect()) == sum(taken.values())
    assert mixing.mixture(empty(docs)).count() == 0 and mixing.mix_documents(empty(docs)).count() == 0


def test_mixture_order_is_weighted_fair_queueing(spark):
    """A plain queue over the same hashes takes the same documents."""
    docs = documents(spark).where("doc_id < 40 AND source IS NOT NULL").dropDuplicates(["doc_id"])
    plan = mixing.mixture(docs).collect()
    hashes = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(17, doc_id, xxhash64(coalesce(text, ''))) AS h").collect()}
    queue = []
    for key in {r.key for r in plan}:
        mine = sorted((r for r in plan if r.key == key), key=lambda r: (hashes[r.doc_id] % 2**64, r.doc_id))
        run = 0
        for n in (0, 1):
            for r in mine:
                run += r.size
                if 2 * run - r.size <= 2 * r.target:
                    queue.append((run / r.target, key, n, hashes[r.doc_id], r))
    budget, taken = 1.5 * sum(r.size for r in plan), collections.Counter()
    for *_, r in sorted(queue):
        if r.size > budget:
            break
        budget -= r.size
        taken[r.doc_id] += r.size
    assert {r.doc_id: r.taken for r in plan if r.taken} == dict(taken)


def test_mixed_documents_come_in_order_of_finish_times(spark):
    docs = documents(spark).where("doc_id < 40").dropDuplicates(["doc_id"])
    plan = {r.doc_id: r for r in mixing.mixture(docs).collect()}
    queue = sorted((c.finish, r.key, c["pass"], r.h, r.doc_id) for r in plan.values() for c in r.copies)
    assert [r.doc_id for r in mixing.mix_documents(docs).collect()] == [q[-1] for q in queue]
    assert mixing.mix_documents(docs).rdd.getNumPartitions() == 4


def test_successors(spark):
    keys = [3, 4, 9, 4095, 4096, 20000, 10**12, -5]
    got = {r.k: r.next_key for r in successors(spark.createDataFrame([(k,) for k in keys], "k long"), "k", block=16).collect()}
    ordered = sorted(keys)
    assert got == dict(zip(ordered, [*ordered[1:], None]))
