"""N-gram join, winnowing and license scans against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rotaspark.llm import license_scan, ngram_join, winnowing, wordhash
from rotaspark.llm.components import components
from rotaspark.llm.license_texts import PHRASES, TEMPLATES

from .support import documents, empty, prose, rows_of

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def grams(text):
    words = ALNUM.findall(lowered(text))
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def joined(rows):
    """rep and class of each text, and links of each representative, by comparing all pairs."""
    sets = {r.doc_id: grams(r.text) for r in rows if r.doc_id is not None}
    reps = {}
    for i in sorted(sets):
        reps.setdefault(sets[i] or i, i)
    group, links = {i: i for i in reps.values()}, Counter()
    ids = [i for i in reps.values() if sets[i]]
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links.update((a, b))
                low, high = sorted((group[a], group[b]))
                group = {k: low if v == high else v for k, v in group.items()}
    return {i: (group[r := reps[sets[i] or i]], r, links[r]) for i in sets}


def near_copies(spark, n=40):
    rng = random.Random(9)
    base = prose(rng, 300).split(" ")
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 12)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(words), "en", "a", 1, "x"))
    return rows


@pytest.mark.parametrize("limit", [("BLOCK", 8), ("BLOCK_GRAMS", 1500)])
def test_ngram_join(spark, monkeypatch, limit):
    monkeypatch.setattr(ngram_join, *limit)
    base = documents(spark, extra="class_id").where("NOT (doc_id = 6 AND n_chars = 1 AND text LIKE 'another%')")
    docs = base.union(spark.createDataFrame(near_copies(spark), base.schema))
    want = joined(docs.collect())
    got = ngram_join.similarity_classes(docs)
    assert got.columns == ["doc_id", "class_id", "rep_id", "n_copies", "n_links"]
    rows = rows_of(got)
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] is None:
            assert (r["class_id"], r["n_links"]) == (None, 0)
        else:
            assert (r["class_id"], r["rep_id"], r["n_links"]) == want[r["doc_id"]], r
    assert max(r["n_links"] for r in rows) > 8
    one = ngram_join.one_per_class(docs)
    assert one.columns == docs.columns
    ids = [r.doc_id for r in one.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted({c for c, _, _ in want.values()})
    assert ngram_join.similarity_classes(empty(docs)).count() == 0 and ngram_join.one_per_class(empty(docs)).count() == 0


def test_several_texts_with_one_id(spark):
    docs = documents(spark)
    assert ngram_join.similarity_classes(docs).count() == docs.count()


def test_one_row_per_class(spark):
    base = documents(spark)
    near = near_copies(spark, 6)
    lone = prose(random.Random(77), 200)
    more = [(5, base.where("doc_id = 5").first().text, "en", "a", 1, "other columns")]
    more += [*near, (None, near[0][1] + " more", "en", "a", 1, "near a row with an id")]
    more += [(None, lone, "en", "a", 1, "x")] * 3 + [(None, lone + " more", "en", "b", 1, "near"), (None, lone.upper(), "en", "b", 1, "copy")]
    more += [(700, "several texts of one id", "en", "a", 1, "x"), (700, "Several texts of one id", "en", "a", 1, "x"), (700, near[0][1], "en", "a", 1, "x")]
    docs = base.union(spark.createDataFrame(more, base.schema))
    got = ngram_join.one_per_class(docs).collect()
    rows = [r for r in docs.collect() if r.doc_id is not None]
    want = joined([r for r in rows if r.doc_id not in (6, 700)])
    heads = sorted({c for c, _, _ in want.values()} - {1000} | {6}) + [6]
    assert sorted(r.doc_id for r in got if r.doc_id not in (None, 700, 1000)) == sorted(heads)
    # One text of 700 is that of 1000: whichever of the two ids stands, there is one row of it and one of the other text.
    both = Counter(r.text.lower() for r in got if r.doc_id in (700, 1000))
    assert both == Counter([near[0][1].lower(), "several texts of one id"])
    alone = [r.text for r in got if r.doc_id is None]
    assert Counter(t for t in alone if t not in (lone, lone + " more", lone.upper())) == Counter(["no id and a text of its own", None])
    assert len(alone) == 3
    again = ngram_join.one_per_class(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_pruning_bounds():
    least = ngram_join.least_matches(0.8, 1e-9)
    assert least[16] < 12 and least[128] > 50
    for n, m in least.items():
        assert ngram_join.posterior(m, n, 0.8) >= 1e-9
        assert m == 0 or ngram_join.posterior(m - 1, n, 0.8) < 1e-9
    draw = np.random.default_rng(2)
    density = draw.beta(21, 13, 200_000)
    assert abs((density >= 0.7).mean() - ngram_join.posterior(20, 32, 0.7)) < 0.01


def test_components(spark):
    edges = [(1, 2), (3, 2), (9, 8), (8, 7), (7, 6), (6, 5), (20, 20), (1, 2)] + [(100 + i, 101 + i) for i in range(50)]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5} | {100 + i: 100 for i in range(51)}


def slow_winnow(text, k, w):
    k = min(k, len(text))
    values = [int(h) for h in winnowing.span_hashes(winnowing.code_points(text), np.arange(len(text) - k + 1), np.arange(len(text) - k + 1) + k)]
    chosen = set()
    for end in range(1, len(values) + w):
        window = range(max(0, end - w), min(end, len(values)))
        chosen.add(min(window, key=lambda i: (values[i], -i)))
    return sorted(chosen)


def test_winnow_takes_the_rightmost_minimum_of_every_window(monkeypatch):
    rng = random.Random(4)
    for n in (1, 3, 8, 9, 40, 300):
        for letters in ("ab", "abcdefghij é日"):
            text = "".join(rng.choice(letters) for _ in range(n))
            at, hashes = winnowing.winnow(text, 8, 16)
            assert at.tolist() == slow_winnow(text, 8, 16)
    for run in (1, 5, 64):  # the runs of windows leave no seam
        monkeypatch.setattr(winnowing, "_RUN", run)
        text = "".join(rng.choice("abc") for _ in range(200))
        assert winnowing.winnow(text, 8, 16)[0].tolist() == slow_winnow(text, 8, 16)
    assert winnowing.winnow("")[0].size == 0 and winnowing.winnow(None)[0].size == 0


def test_shared_passages_share_a_fingerprint():
    rng = random.Random(6)
    passage = prose(rng, 40)[: winnowing.WINDOW + winnowing.K - 1]
    for _ in range(20):
        a, b = (prose(rng, 30) + passage + prose(rng, 30) for _ in range(2))
        assert np.intersect1d(winnowing.winnow(a)[1], winnowing.winnow(b)[1]).size


def test_edited_likeness(spark):
    docs = documents(spark, extra="fingerprint")
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, (r.text or "").encode()))
    want, prints = Counter(), defaultdict(set)
    for r, after in zip(rows, [*rows[1:], rows[0]]):
        text, following = r.text or "", after.text or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + following[:n]
        bags = [winnowing.bag(winnowing.winnow(t)[1]) for t in (text, edited, following)]
        want[r.doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), winnowing.likeness(*bags[:2]), winnowing.likeness(bags[0], bags[2])] += 1
    got = rows_of(winnowing.edited_likeness(docs))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got) == want
    for r in got:
        prints[r["fingerprint"]].add(r["doc_id"])
    assert {3, 106} in prints.values() or any({3, 106} <= p for p in prints.values())
    assert winnowing.edited_likeness(empty(docs)).count() == 0
    alone = rows_of(winnowing.edited_likeness(docs.where("doc_id = 8")))
    assert [(r["doc_id"], r["near_next"]) for r in alone] == [(8, 1.0)]
    assert winnowing.fingerprints(docs).where("doc_id = 8").count() > 10


def test_word_hashes_have_no_seams(monkeypatch):
    text = prose(random.Random(3), 300) + " " + "x" * 500 + " one more"
    whole = license_scan.words_of(text)
    assert whole.size == len(ALNUM.findall(text)) and len(set(whole.tolist())) == len(set(ALNUM.findall(text)))
    for run in (1, 7, 100, 5000):
        monkeypatch.setattr(wordhash, "_RUN", run)
        assert (license_scan.words_of(text) == whole).all()


def places(words, phrase):
    phrase = phrase.split()
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]


def test_license_scan(spark):
    mit = TEMPLATES[4][1]
    base = documents(spark, extra="labels")
    rng = random.Random(8)
    cases = {
        500: "All Rights reserved. cc by, CC-BY; cc\nby all rights reserved",
        501: "xcc by all rights reservedly general public license",
        502: prose(rng, 50) + "\n" + mit + "\n" + prose(rng, 50),
        503: mit.replace("associated ", "").replace("sublicense", "sub license").upper(),
        504: " ".join(mit.split()[:40]),
        505: "Licensed under CC BY-NC 4.0.",
        506: "This work is licensed under the GNU General Public License, version 3.",
        507: "the of the software in the rights to use copy",
        508: "all rights reserved " * 500,
    }
    docs = base.union(spark.createDataFrame([(i, t, "en", "a", 1, "x") for i, t in cases.items()], base.schema))
    got = license_scan.scan_licenses(docs).collect()
    assert len(got) == docs.count()
    texts = defaultdict(set)
    for r in docs.collect():
        texts[r.doc_id].add(r.text)
    for r in got:
        if len(texts[r.doc_id]) > 1:
            continue
        words = ALNUM.findall(lowered(next(iter(texts[r.doc_id]))))
        found = {label: places(words, p) for p, label in PHRASES.items()}
        every = [i for x in found.values() for i in x]
        assert (r.n_words, r.n_base) == (len(words), len(every))
        assert (r.first_word, r.last_word) == ((min(every), max(every)) if every else (None, None))
        base_labels = {label for label, x in found.items() if x}
        assert r.base_labels == ",".join(sorted(base_labels)) and base_labels <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1
    labels = {r.doc_id: r.labels for r in got}
    assert labels[502] == labels[503] == "mit" and labels[504] == "" and labels[507] == ""
    assert labels[505] == "cc-by,cc-by-nc-4.0" and labels[506] == "gpl,gpl-3.0" and labels[508] == "reserved"
    assert labels[8] == "" and labels[103] == ""
    assert license_scan.scan_licenses(empty(docs)).count() == 0


def test_neighbouring_licenses_are_told_apart(spark):
    gpl, lgpl = (next(t for label, t in TEMPLATES if label == x and "published" in t) for x in ("gpl", "lgpl"))
    by, short = (next(t for label, t in TEMPLATES if label == x and "This work" in t) for x in ("cc-by-4.0", "gpl-3.0"))
    apache = next(t for label, t in TEMPLATES if label == "apache-2.0" and "http" in t)
    cases = [(text, {label}) for label, text in TEMPLATES] + [
        (gpl.replace("This program is free", "This library is free"), {"gpl"}),
        (gpl.split(", either")[0], set()),
        (lgpl.replace("This library", "This program"), {"lgpl"}),
        (lgpl.replace("Lesser", "Library"), {"lgpl"}),
        (by.replace("Attribution", "Attribution-NoDerivatives"), set()),
        (by.replace("Attribution", "Attribution-NonCommercial-ShareAlike"), set()),
        (by.replace("4.0", "3.0"), set()),
        (short.replace("version 3", "version 2"), set()),
        (short.replace("General", "Affero General"), set()),
        (short.replace("GNU", "Gnu").replace("This work", "The work"), {"gpl-3.0"}),
        (apache.replace("2.0", "1.1"), set()),
        (apache.replace("express or ", "").replace("a copy of ", ""), {"apache-2.0"}),
    ]
    docs = spark.createDataFrame([(i, f"some words before. {t} and some after") for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    for i, (text, want) in enumerate(cases):
        labels, base = (set(x.split(",")) - {""} for x in (got[i].labels, got[i].base_labels))
        assert labels == want | base, (text, labels)
