import random
from collections import Counter

import pytest

from siftprint.llm import linededup

from .conftest import sentence


def brute(docs, least):
    """docs: (doc_id, text), distinct. The texts after deletion, from the definition: of equal runs
    of ``least`` words or more the first stays."""
    lines = {}
    for doc, text in docs:
        lines[doc] = [(k, " ".join(x.split()), len(x.split())) for k, x in enumerate((text or "").split("\n")) if x.split()]

    def runs(doc):
        own = lines[doc]
        for i in range(len(own)):
            total = 0
            for j in range(i, len(own)):
                total += own[j][2]
                if total >= least:
                    yield i, j
                    if total - own[i][2] >= least and j > i and total - own[j][2] >= least and len(own) > 200:
                        break  # longer runs consist of shorter ones

    first = {}
    for doc in sorted(lines):
        for i, j in runs(doc):
            first.setdefault(tuple(x[1] for x in lines[doc][i : j + 1]), (doc, i, j))

    out = {}
    for doc, text in docs:
        gone = set()
        for i, j in runs(doc):
            other, a, z = first[tuple(x[1] for x in lines[doc][i : j + 1])]
            if (other, a) != (doc, i):
                gone |= set(range(max(i, z + 1) if other == doc else i, j + 1))
        drop = {lines[doc][k][0] for k in gone}
        drop |= {x for k in gone if k - 1 in gone for x in range(lines[doc][k - 1][0], lines[doc][k][0])}
        out[doc] = (text if not gone else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in drop), len(gone))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [sentence(rng, rng.choice([1, 3, 8, 12, 30, 60])) for _ in range(40)]
    runs = [rng.sample(pool, rng.randint(1, 6)) for _ in range(8)]
    docs = []
    for d in range(60):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts += rng.choice(runs) if rng.random() < 0.5 else [rng.choice(pool) if rng.random() < 0.3 else sentence(rng, rng.randint(1, 40)), rng.choice(["", "  "])]
        docs.append((d, "\n".join(parts)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: (r.text, r.n_removed_lines) for r in linededup.dedup_lines(df, min_words=20).collect()}
    assert got == brute(docs, 20)
    before = {" ".join(x.split()) for _, t in docs for x in t.split("\n")}
    after = {" ".join(x.split()) for t, _ in got.values() for x in t.split("\n")}
    assert before - {""} == after - {""}  # no line is lost from the corpus
    assert sum(n for _, n in got.values()) > 20


def test_long_single_line_and_clean_documents(spark):
    rng = random.Random(3)
    passage = sentence(rng, 55)
    docs = [(d, "\n".join([sentence(rng, 40), passage, sentence(rng, 45)]) if d % 2 else sentence(rng, 80)) for d in range(10)]
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    for d, text in docs:
        assert got[d].n_removed_lines == (1 if d % 2 and d > 1 else 0)
        assert (passage in got[d].text) == (d == 1)
        if d % 2 == 0:
            assert got[d].text == text


def test_run_repeated_in_one_document(spark):
    line = " ".join(f"w{i}" for i in range(60))
    got = linededup.dedup_lines(spark.createDataFrame([(1, "\n".join([line] * 5 + ["end"]))], "doc_id bigint, text string")).first()
    assert (got.text, got.n_lines, got.n_removed_lines, got.n_removed_words) == (f"{line}\nend", 6, 4, 240)


def test_awkward(spark, awkward, awkward_rows, empty):
    out = linededup.dedup_lines(awkward)
    assert out.columns == [c for c in awkward.columns if c != "n_lines"] + linededup.RESULTS
    got = Counter((r.doc_id, r.text) for r in out.collect())
    want = brute(list({(d, t): None for d, t, *_ in awkward_rows}), 50)
    assert got == Counter((d, want[d][0]) for d, *_ in awkward_rows)
    assert dict(got).keys() >= {(0, None), (1, "")}
    assert linededup.dedup_lines(empty).count() == 0


def test_null_ids_stay(spark):
    text = " ".join(["w"] * 70)
    got = linededup.dedup_lines(spark.createDataFrame([(None, text), (None, text), (3, text)], "doc_id bigint, text string")).collect()
    assert [r.text for r in got] == [text] * 3


def test_later_line_of_a_run_goes_though_the_first_place_lacks_it(spark):
    rng = random.Random(9)
    long_, short = sentence(rng, 60), sentence(rng, 45)
    docs = [(1, long_), (2, f"{long_}\n{short}"), (3, f"{long_}\n{short}"), (4, f"{short}\n{sentence(rng, 70)}"), (5, f"{short}\n{long_}"), (6, f"{short}\n{long_}")]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {1: long_, 2: short, 3: "", 4: docs[3][1], 5: short, 6: ""}


def test_one_fingerprint_a_minimum(spark):
    rng = random.Random(4)
    text = "\n".join(sentence(rng, 3) for _ in range(800))
    hashes, words, _, _ = linededup.units(text)
    chosen = {}
    for i, j in linededup.windows(words, 50):
        at = max(range(i, j + 1), key=lambda k: (-hashes[k], k))
        chosen.setdefault(at, []).append((i, j))
    assert [(i, j, at) for at, runs in chosen.items() for i, j in runs] == list(linededup.selected(hashes, words, 50))
    places = linededup.fingerprints(spark.createDataFrame([(1, 2, text)], "doc_id bigint, th bigint, text string")).collect()
    assert sorted(r["at"] for r in places) == sorted(chosen) and len(places) < 800 / 5


def test_common_line_meets_nothing(spark):
    """A third of all rows share a line of few words; it is everybody's fingerprint or nobody's."""
    rng = random.Random(5)
    line = min((sentence(rng, 4) for _ in range(300)), key=lambda x: linededup.units(x)[0][0])
    docs = [(d, "\n".join([sentence(rng, 30), line, sentence(rng, 30)] if d % 3 == 0 else [sentence(rng, 60)])) for d in range(900)]
    rows = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == docs


def test_hot_run_is_dealt_over_tasks(spark):
    rng = random.Random(6)
    body = "\n".join(sentence(rng, 20) for _ in range(5))
    docs = [(d, body if d % 3 == 0 else sentence(rng, 60)) for d in range(3000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    assert {r.doc_id: r.text for r in linededup.dedup_lines(df).collect()} == {d: t if t != body or d == 0 else "" for d, t in docs}
