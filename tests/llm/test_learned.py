"""Toxicity on held-out rows, preference formatting against plain Python, and the pipeline."""

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import Row

import corpus_pipeline
from rotaspark.llm import preferences, toxicity
from rotaspark.llm.queries import op5_toxicity, op6_preference_format

from .support import documents, empty, prose, rows_of
from .test_filters import WORD, deduped, shared_out, verdicts
from .test_matches import joined
from .test_tokens import LIBRARY


def test_pairs_of_terms_count_beyond_their_sum():
    """Label 1 only where both terms stand: no sum of weights with these margins fits, the factors do."""
    draw = np.random.default_rng(1)
    rows, labels = [], []
    for _ in range(4000):
        a, b = draw.integers(0, 2, 2)
        noise = draw.integers(10, 60, 5)
        rows.append(np.unique(np.array([0] * a + [1] * b + noise.tolist(), np.int32)))
        labels.append(float(a == b))
    machine = toxicity.FactorizationMachine(np.arange(60))
    machine.fit(rows, np.array(labels), epochs=30)
    good = sum((machine.raw(r) > 0) == y for r, y in zip(rows, labels))
    assert good > 0.95 * len(rows)


def test_scores_are_the_plain_sum_over_pairs(spark):
    """Bias, a weight per term and a product per pair of terms, added up one by one, for every document of the query."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in op5_toxicity(spark, "/root/testdata/sf0.001").collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for d in rows:
        at = machine.places(toxicity.terms(d.text))
        raw = machine.bias + sum(machine.weights[i] for i in at)
        raw += sum(machine.factors[i] @ machine.factors[j] for k, i in enumerate(at) for j in at[:k])
        assert abs(got[d.doc_id] - 1 / (1 + np.exp(-min(max(raw, -30), 30)))) < 1e-9


def test_terms_are_counted_on_all_labels(spark, monkeypatch):
    """A word that only rows beyond the fitted ones hold is known, though the fit sees few rows."""
    rng = random.Random(3)
    rows = [(i, prose(rng, 30) + (" zebra" if i % 5 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels, rows=2)
    assert machine.places(toxicity.terms("zebra")).size == 2  # the word, and its start of four
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", 0)  # the same by a shuffle
    other = toxicity.train(docs, labels, rows=2)
    assert (other.place == machine.place).all() and (other.factors == machine.factors).all()


def toxic_table(spark, n=1500):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randint(20, 120)).split(" ")
        toxic = rng.random() < 0.2
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "scum", "trash", "Loser"]))
        docs.append((i, " ".join(words), "en", "a", 1, "x"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity(spark):
    base = documents(spark, extra="score")
    docs, labels = toxic_table(spark)
    docs = base.where("doc_id IS NULL OR doc_id > 99").union(spark.createDataFrame(docs, base.schema))
    known = spark.createDataFrame([*labels, (3, 1, 0), (None, 1, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    machine = toxicity.train(docs, known)
    got = rows_of(toxicity.score(docs, machine))
    assert Counter(r["doc_id"] for r in got) == Counter(r.doc_id for r in docs.collect())
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth and not 99 < r["doc_id"] < 110]
    assert 250 < len(held) < 500
    wrong = sum(r["predicted"] != truth[r["doc_id"]] for r in held)
    assert wrong < 0.03 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    again = rows_of(toxicity.score(docs, toxicity.train(docs.repartition(5), known)))
    assert sorted((str(r["doc_id"]), r["score"]) for r in again) == sorted((str(r["doc_id"]), r["score"]) for r in got)


def test_toxicity_without_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    machine = toxicity.train(docs, labels)
    assert {r["predicted"] for r in rows_of(toxicity.score(docs, machine))} == {0}
    assert toxicity.score(empty(docs), machine).count() == 0


def paired(rows):
    convs, order = {}, lambda t: tuple((x is not None, x if x is not None else 0 if k == 0 else "") for k, x in enumerate(t))
    for r in rows:
        convs.setdefault(r.conv_id if r.conv_id is not None else (r.turn, r.role, r.text), []).append((r.turn, r.role, r.text))
    convs = {k: sorted(v, key=order) for k, v in convs.items()}
    at = {k: max((i for i, t in enumerate(v) if t[1] == "assistant"), default=None) for k, v in convs.items()}
    ids = sorted(k for k in convs if not isinstance(k, tuple) and at[k] is not None)
    out = {}
    for k, v in convs.items():
        if at[k] is None or not ids:
            out[k] = (None, v, v)
            continue
        other = ids[0] if isinstance(k, tuple) else ids[(ids.index(k) + 1) % len(ids)]
        chosen = v[: at[k] + 1]
        out[k] = (other, chosen, [*chosen[:-1], (chosen[-1][0], chosen[-1][1], convs[other][at[other]][2])])
    return out


def text_of(turns):
    return "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for _, r, t in turns)


def test_preferences(spark):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "bye"),
        (2, 0, "system", "be kind"), (2, 1, "user", "hi"), (2, 2, "assistant", "hello"),
        (4, 0, "user", "no reply"), (7, 1, "assistant", None), (7, 0, "user", ""), (7, 1, "assistant", None),
        (9, 0, None, "x"), (9, 1, "assistant", "hello " * 5000), (9, None, "assistant", "first"),
        (None, 0, "user", "stray"), (None, 0, "assistant", "stray reply"),
    ]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn int, role string, text string, chosen string")
    pairs = preferences.conversation_pairs(df)
    want = paired(df.collect())
    got = preferences.format_pairs(pairs.withColumnsRenamed({"n_turns": "prompt"}))
    rows = rows_of(got)
    assert len(rows) == len(want)
    for r in rows:
        if r["conv_id"] is None:
            continue
        other, chosen, rejected = want[r["conv_id"]]
        n = 0
        while n < min(len(chosen), len(rejected)) and chosen[n][1:] == rejected[n][1:]:
            n += 1
        assert (r["other_id"], r["n_prompt_turns"], r["prompt"]) == (other, n, text_of(chosen[:n]))
        for side, turns_ in (("chosen", chosen), ("rejected", rejected)):
            assert "".join(s["text"] for s in r[side]) == text_of(turns_[n:])
            assert [s["train"] for s in r[side]] == [x for _, role, _ in turns_[n:] for x in (False, role == "assistant")]
    stray = sorted((r["other_id"] or 0) for r in rows if r["conv_id"] is None)
    assert stray == [0, 1]
    assert preferences.format_pairs(preferences.conversation_pairs(empty(df))).count() == 0


def test_pairs_may_part_at_any_turn(spark):
    kind = "array<struct<turn: bigint, role: string, text: string>>"
    a, b, c = (0, "user", "q"), (1, "assistant", "a"), (2, "user", "r")
    rows = [(1, [a, b, c], [a, b]), (2, [a], [b]), (3, None, [a]), (4, [], None), (5, [a, b], [a, b])]
    got = {r["k"]: r for r in rows_of(preferences.format_pairs(spark.createDataFrame(rows, f"k int, chosen {kind}, rejected {kind}")))}
    assert [got[k]["n_prompt_turns"] for k in (1, 2, 3, 4, 5)] == [2, 0, 0, 0, 2]
    assert len(got[1]["chosen"]) == 2 and got[1]["rejected"] == [] and len(got[3]["rejected"]) == 2


def test_pipeline_stages(spark, tmp_path):
    docs = documents(spark, extra="kept")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "BPE encoding and decoding",
    ]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        now = spark.read.parquet(str(tmp_path / str(i)))
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, run.collect())) == sorted(map(str, now.collect()))
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(run.columns) and run.count() > 20


def test_pipeline_equals_plain_versions(spark, tmp_path):
    """Plain Python for every stage, one after the other, over texts of the given table and copies of some."""
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    rng = random.Random(4)
    rows = [(d.doc_id, d.text, d.lang, d.source, d.n_chars) for d in given]
    for i in range(25):
        _, text, lang, source, n = rows[rng.randrange(len(given))]
        words = (text or "").split(" ")
        words[rng.randrange(len(words))] = "altered"
        rows.append((1000 + i, text if i % 2 else " ".join(words), lang, source, n))
    shared = "a line that stands in many documents, again and again"
    rows = [(i, f"{t}\n{shared}" if i % 9 == 0 else t, *rest) for i, t, *rest in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    now = [Row(doc_id=i, text=t, lang=a, source=b) for i, t, a, b, _ in rows]
    kept = {r[1] for r in verdicts(now) if r[4]}
    now = [r for r in now if r.doc_id in kept]
    texts = {i: text for _, i, _, _, text in deduped(now)}
    now = [Row(doc_id=r.doc_id, text=texts[r.doc_id], lang=r.lang, source=r.source) for r in now]
    classes = joined(now)
    now = [r for r in now if classes[r.doc_id][0] == r.doc_id]
    mixed = queued(spark, now)
    want = Counter()
    for r in now:
        ids = LIBRARY.encode(r.text, add_special_tokens=False).ids
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text)]
        want[r.doc_id, len(ids), *digests] += mixed[r.doc_id]
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == +want and len(got) > 100 and len(kept) < len(rows) and len(now) < len(kept)


def queued(spark, rows):
    """How often a plain weighted fair queue takes each document."""
    sizes, groups = Counter(), {}
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text))
        groups.setdefault(r.source, []).append(r)
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    target = shared_out({s: sizes[s] for s in order}, [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()))
    hashes = dict(spark.createDataFrame([(r.doc_id, r.text) for r in rows], "i long, t string").selectExpr("i", "xxhash64(17, i, xxhash64(t))").collect())
    queue = []
    for s, mine in groups.items():
        mine.sort(key=lambda r: (hashes[r.doc_id] % 2**64, r.doc_id))
        run = 0
        for n in (0, 1):
            for r in mine:
                size = len(WORD.findall(r.text))
                run += size
                if size and 2 * run - size <= 2 * target[s]:
                    queue.append((run / target[s], "n" if s is None else f"s{s}", n, hashes[r.doc_id], r.doc_id, size))
    budget, taken = 1.5 * sum(sizes.values()), Counter()
    for *_, i, size in sorted(queue):
        if size > budget:
            break
        budget -= size
        taken[i] += 1
    return taken


def test_pipeline_of_nothing(spark, tmp_path):
    now = empty(documents(spark))
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
    assert now.count() == 0


def test_registered_preferences(spark):
    rows = op6_preference_format(spark, "/root/testdata/sf0.001")
    assert rows.count() == 20 and rows.where("n_prompt_turns > 0").count() == 20
