import random
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.orc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftprint.llm import packing, shared, tokencount, tokenorc, tokens

from .conftest import WORDS


def library_ids(path, text):
    return tokens.tokenizer(path).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(array("I", ids).tobytes())


PARTS = ["a", "B", "é", "ß", "İ", "Σ", "ς", "1", "２", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "'", "'s", "don't", "'LL", ".", ",", "...", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "é", "́", "ﬁ", "日本", "🙂", "ª", "µ", "×", "$$$", "_", "Ÿ"]


@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
@settings(max_examples=400, deadline=None)
def test_encoder_is_the_library(text):
    path = tokens.word_tokenizer_path()
    assert tokens.word_encoder(path).encode([text])[0] == array("I", library_ids(path, text)).tobytes()


@given(st.lists(st.none() | st.lists(st.sampled_from([*PARTS, "<", "|", "÷", "É,", "ÿ.", "Þ!", "þ-"]), max_size=8).map("".join), max_size=8))
@settings(max_examples=400, deadline=None)
def test_encoder_of_many_texts_is_the_library(texts):
    """Neighbours don't touch: a text outside Latin-1 or with a special string beside plain ones, null and empty ones."""
    path = tokens.word_tokenizer_path()
    ids, ends = tokens.word_encoder(path).encode_array(pa.array(texts, pa.string()))
    want = [library_ids(path, t) for t in texts]
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == want and len(ids) == sum(map(len, want))


def test_only_distinct_pieces_become_objects():
    """Python's objects while a batch is looked up follow its distinct pieces, not its 180,000 pieces."""
    path = tokens.word_tokenizer_path()
    enc, blocks = tokens.WordEncoder(path), []
    learn = enc._learn
    enc._learn = lambda wanted: blocks.append(sys.getallocatedblocks()) or learn(wanted)
    text = "Two words, two WORDS; and\nDéjà déjà vu. " * 50
    before = sys.getallocatedblocks()
    assert enc.encode([text] * 400) == [array("I", library_ids(path, text)).tobytes()] * 400
    assert blocks[0] - before < 10_000


def test_encoder_forgets_within_bounds():
    path = tokens.word_tokenizer_path()
    enc = tokens.WordEncoder(path, remembered=50)
    rng = random.Random(1)
    for _ in range(30):
        text = " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(40))
        assert enc.encode([text])[0] == array("I", library_ids(path, text)).tobytes()
    assert len(enc.new) < 150 and len(enc.old) < 150


@given(st.lists(st.sampled_from([p for p in PARTS if p != "日本"] + ["the ", " of", "word"]), max_size=30).map("".join), st.integers(1, 20))
@settings(max_examples=300, deadline=None)
def test_lengths_with_splits_are_the_library(text, most):
    tok = tokens.tokenizer(tokens.byte_tokenizer_path())
    assert tokencount.lengths(tok, [text], most) == [len(tok.encode(text, add_special_tokens=False).ids)]
    assert "".join(tokencount.segments(text, most)) == text


@pytest.mark.parametrize("text", ["Широкая электрификация южных губерний. " * 400, "一二三四五、六七八九十。" * 800, "نص عربي طويل، " * 700, "한국어 문장입니다. " * 700, "line\nline\tword\r\n" * 900, "<|endoftext|>don't, x's! " * 500])
def test_long_texts_of_any_script_are_split(text):
    tok = tokens.tokenizer(tokens.byte_tokenizer_path())
    parts = list(tokencount.segments(text, 1000))
    assert "".join(parts) == text and max(len(p.encode()) for p in parts) < 1200
    assert tokencount.lengths(tok, [text], 1000) == [len(tok.encode(text, add_special_tokens=False).ids)]


def test_count(spark, awkward, awkward_rows, empty):
    got = Counter(map(tuple, tokencount.count(awkward, batch=1000).collect()))
    want = Counter()
    for doc, text, *_ in awkward_rows:
        n = len(library_ids(tokens.byte_tokenizer_path(), text))
        want[doc, len((text or "").encode()), n, n > 1024] += 1
    assert got == want
    assert tokencount.count(empty).count() == 0


@given(st.lists(st.integers(1, 100), max_size=200))
@settings(max_examples=200, deadline=None)
def test_best_fit(sizes):
    bins = packing.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    fills = [sum(sizes[i] for i in b) for b in bins]
    assert all(0 < f <= 100 for f in fills)
    assert sum(f <= 50 for f in fills) <= 1  # two of them would be one
    assert len(bins) <= 11 / 9 * max(1, -(-sum(sizes) // 100)) * 1.5 + 1


def fewest(sizes, room):
    """Number of bins of best fit, largest first, piece by piece."""
    free, n = [], 0
    for size in sorted(sizes, reverse=True):
        at = bisect_left(free, size)
        if at == len(free):
            n += 1
            left = room - size
        else:
            left = free.pop(at) - size
        insort(free, left)
    return n


@given(st.dictionaries(st.integers(1, 100), st.integers(1, 60), max_size=30))
@settings(max_examples=200, deadline=None)
def test_plan_is_best_fit(counts):
    runs, left = packing.plan(counts, 100)
    sizes = np.array([s for s, n in counts.items() for _ in range(n)], np.int64)
    numbers = np.array([k for n in counts.values() for k in range(n)], np.int64)
    ends = {}
    for seq, at, size in sorted(zip(*(x.tolist() for x in packing.place(runs, sizes, numbers)), sizes.tolist())):
        assert at == ends.get(seq, 0)
        ends[seq] = at + size
    assert max(ends.values(), default=0) <= 100
    assert len(ends) == fewest(sizes.tolist(), 100)
    room = {first + i: fill for first, n, fill in left.tolist() for i in range(n)}
    assert room == {s: f for s, f in ends.items() if f < 100}


def pack_of_sizes(spark, sizes, length, **more):
    """Sequences by the level that emitted them, of documents of so many ids by partition, and the number that one best fit makes."""
    word = next(w for w in WORDS if len(library_ids(tokens.word_tokenizer_path(), f"{w} {w}")) == 2)
    rows = [(p << 32 | i, " ".join([word] * (n - 1))) for p, part in enumerate(sizes) for i, n in enumerate(part)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 1), "doc_id bigint, text string")
    docs = docs.repartitionByRange(len(sizes), "doc_id").sortWithinPartitions("doc_id")
    rows = packing.pack(docs, length=length, **more).select("sequence_id", "offset", "length").collect()
    assert sorted(r.length for r in rows) == sorted(n for part in sizes for n in part)
    ends = {}
    for r in sorted(rows):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= length
    return Counter(i >> 60 for i in ends), fewest([n for part in sizes for n in part], length)


def test_pack_of_rows_clustered_by_length(spark):
    rng = random.Random(6)
    sizes = sorted(rng.randint(1, 255) for _ in range(12_000))
    got, want = pack_of_sizes(spark, [sizes[i : i + 3000] for i in range(0, len(sizes), 3000)], 256, leaf=1000, fan_in=3)
    assert want <= sum(got.values()) <= 1.02 * want + 1


def test_pack_of_large_partitions_beside_small_pieces(spark):
    rng = random.Random(7)
    large = [[rng.randint(137, 187) for _ in range(3000)] for _ in range(2)]
    small = [[rng.randint(106, 118) for _ in range(1500)] for _ in range(2)]
    got, want = pack_of_sizes(spark, [*large, *small], 256, leaf=800, fan_in=4)
    assert want <= sum(got.values()) <= 1.02 * want + 1


@pytest.mark.parametrize("leaf,fan_in,levels", [(10**6, 16, 1), (250, 16, 2), (40, 8, 3)])
def test_underfull_sequences_are_items_at_every_level(spark, leaf, fan_in, levels):
    """Few pieces a leaf, so that most leaves have underfull sequences of small fills, which merge above."""
    rng = random.Random(8)
    sizes = [rng.randint(5, 60) for _ in range(2400)]
    got, want = pack_of_sizes(spark, [sizes], 256, leaf=leaf, fan_in=fan_in)
    assert sorted(got) == list(range(levels))
    assert want <= sum(got.values()) <= 1.02 * want + 1
    least = -(-sum(sizes) // 256)
    assert sum(got.values()) <= 1.05 * least


def check_packing(rows, docs, length, path, end=0):
    pieces = Counter()
    for doc, text in docs:
        ids = library_ids(path, text) + [end]
        for k, at in enumerate(range(0, len(ids), length)):
            part = ids[at : at + length]
            pieces[doc, k, at, len(part), crc(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces
    places = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == places.get(r.sequence_id, 0)
        places[r.sequence_id] = r.offset + r.length
    assert max(places.values(), default=0) <= length
    return len(places), sum(places.values())


@pytest.mark.parametrize("partitions,fan_in,leaf", [(1, 16, 10**6), (7, 2, 30)])
def test_pack(spark, small, partitions, fan_in, leaf):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").repartition(partitions)
    rows = packing.pack(docs, fan_in=fan_in, leaf=leaf).collect()
    n, total = check_packing(rows, [tuple(r) for r in docs.collect()], 2048, tokens.word_tokenizer_path())
    assert n <= -(-total // 2048) * 1.05 + 1


def test_pack_awkward(awkward, awkward_rows, empty):
    rows = packing.pack(awkward, length=64, fan_in=2, leaf=100).collect()
    n, total = check_packing(rows, [(d, t) for d, t, *_ in awkward_rows], 64, tokens.word_tokenizer_path())
    assert n <= total / 64 * 1.1 + 2
    assert packing.pack(empty).count() == 0


def test_orc(spark, awkward, awkward_rows, empty):
    rows = sorted(tokenorc.store_and_digest(awkward).collect())
    path = tokens.word_tokenizer_path()
    at, want = 0, []
    for doc, text in sorted(((d, t) for d, t, *_ in awkward_rows), key=lambda r: r[0]):
        ids = library_ids(path, text) + [2]
        want.append((doc, at, len(ids), crc(ids)))
        at += len(ids)
    assert [tuple(r) for r in rows] == want
    assert tokenorc.store_and_digest(empty).count() == 0


def test_orc_of_one_id(spark):
    docs = spark.range(3000).selectExpr("CAST(7 AS BIGINT) AS doc_id", "concat('word', id % 10) AS text").union(spark.range(500).selectExpr("CAST(NULL AS BIGINT)", "'none'")).repartition(4)
    out = shared.fresh_path(spark, "test-orc") + "/ids"
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 100)
    try:
        tokenorc.write(docs, out)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    files = tokenorc.read(spark, out).groupBy(F.input_file_name()).count().collect()
    assert len(files) > 20 and max(r[1] for r in files) <= 100  # no task has all rows of the id
    rows = sorted(tokenorc.digest(spark, out).collect(), key=lambda r: r.start)
    assert rows[0].doc_id is None and [r.doc_id for r in rows[500:]] == [7] * 3000
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]


def test_orc_files(spark, tmp_path):
    """Stripes, run-length encoding, row index and Bloom filter, read from the files themselves."""
    docs = spark.range(5000).selectExpr("id * 3 AS doc_id", "repeat('the of and ', 20) AS text")
    tokenorc.write(docs.coalesce(1), f"file://{tmp_path}/ids")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    seen = 0
    for p in sorted((tmp_path / "ids").glob("*.orc")):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f"file://{p}"), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        own = pyarrow.orc.ORCFile(str(p))
        assert reader.getStripes().size() == own.nstripes >= 1 and own.row_index_stride == 1000
        column = reader.getSchema().findSubtype("doc_id").getId()
        rows = reader.rows()
        for i in range(own.nstripes):
            footer = rows.readStripeFooter(reader.getStripes().get(i))
            assert footer.getColumns(reader.getSchema().findSubtype("ids").getMaximumId()).getKind().toString() == "DIRECT_V2"  # integer run lengths
            index = rows.readRowIndex(i, None, None)
            groups = index.getRowGroupIndex()[column].getEntryList()
            bounds = [(e.getStatistics().getIntStatistics().getMinimum(), e.getStatistics().getIntStatistics().getMaximum()) for e in groups]
            assert bounds == sorted(bounds) and sum(e.getStatistics().getNumberOfValues() for e in groups) == own.read_stripe(i).num_rows
            kinds = {s.getKind().toString() for s in footer.getStreamsList() if s.getColumn() == column}
            assert "BLOOM_FILTER_UTF8" in kinds and "ROW_INDEX" in kinds
        seen += own.nrows
    assert seen == 5000


def test_orc_row_index_and_bloom_filter(spark, tmp_path):
    """Of every stripe, as the files have them; the reader wants the columns of Bloom filters named."""
    docs = spark.range(12_000).selectExpr("id * 3 AS doc_id", "repeat('the of and ', 20) AS text")
    tokenorc.write(docs.repartition(3), f"file://{tmp_path}/ids")
    gateway = spark.sparkContext._gateway
    jvm, conf = gateway.jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen, groups_seen = set(), 0
    for p in sorted((tmp_path / "ids").glob("*.orc")):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f"file://{p}"), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        own, schema, rows = pyarrow.orc.ORCFile(str(p)), reader.getSchema(), reader.rows()
        column, list_column = schema.findSubtype("doc_id").getId(), schema.findSubtype("ids").getMaximumId()
        assert reader.getStripes().size() == own.nstripes and own.row_index_stride == 1000
        named = gateway.new_array(jvm.boolean, schema.getMaximumId() + 1)
        named[column] = True
        for i in range(own.nstripes):
            ids = own.read_stripe(i, columns=["doc_id"]).column(0).to_pylist()
            footer = rows.readStripeFooter(reader.getStripes().get(i))
            assert footer.getColumns(list_column).getKind().toString() == "DIRECT_V2"  # integer run lengths
            index = rows.readRowIndex(i, None, named)
            kind = index.getBloomFilterKinds()[column]
            groups = index.getRowGroupIndex()[column].getEntryList()
            filters = index.getBloomFilterIndex()[column].getBloomFilterList()
            assert len(groups) == len(filters) == -(-len(ids) // 1000)
            for k, (group, held) in enumerate(zip(groups, filters, strict=True)):
                part, stats = ids[1000 * k : 1000 * k + 1000], group.getStatistics()
                bounds = stats.getIntStatistics()
                assert (bounds.getMinimum(), bounds.getMaximum(), stats.getNumberOfValues()) == (min(part), max(part), len(part))
                bloom = jvm.org.apache.orc.util.BloomFilterIO.deserialize(kind, footer.getColumns(column), reader.getWriterVersion(), schema.findSubtype(column).getCategory(), held)
                assert all(bloom.testLong(x) for x in part[::50])
                absent = [x + 1 for x in part[::5]]
                assert sum(bloom.testLong(x) for x in absent) <= 0.1 * len(absent)
                groups_seen += 1
            seen.update(ids)
    assert seen == set(range(0, 36_000, 3)) and groups_seen > 4


def test_orc_reads_by_id(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = f"file://{tmp_path}/ids"
    tokenorc.write(docs.repartition(3), out)
    some = tokenorc.read(spark, out, [5, 17])
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()
    got = {r.doc_id: list(r.ids) for r in some.collect()}
    text = {r.doc_id: r.text for r in docs.where("doc_id in (5, 17)").collect()}
    assert got == {d: library_ids(tokens.word_tokenizer_path(), t) + [2] for d, t in text.items()}
