"""Alignment of two tokenizers against all pairs of byte ranges."""

import hashlib
import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from tokenizers import Tokenizer

from reviewfold.llm import alignment
from reviewfold.llm.alignment import ByteEncoder, PieceModel, _parts, align_tokens
from tests.llm.samples import words

TEXTS = [
    "Hello  world, it's 12345 o'clock!\n\n\tnew line ",
    "déjà vu 中文字 naïve ﬁn ｆｕｌｌ",
    "<|endoftext|> and <s>tags</s> <0x41> <unk>",
    "emoji 👩‍👩‍👧 and \x00 control \x85 marks",
    "▁ the blank's sign",
    " leading and trailing  ",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "",
    None,
    words(3, 60),
    words(3, 60),
    words(4, 300),
]


def tokens_of(texts):
    """Byte ranges and ids of both sides by the libraries themselves."""
    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = alignment._byte_level()
    for text in texts:
        sides = []
        for ids in ([], []) if not text else (a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)):
            at, spans = 0, []
            for i in ids:
                if not sides:
                    piece = bytes(shown[c] for c in a_side.id_to_token(i))
                else:
                    name = b_side.id_to_piece(i)
                    piece = bytes([int(name[3:5], 16)]) if b_side.is_byte(i) else name.replace("▁", " ").encode()
                spans.append((at, at + len(piece), i, piece))
                at += len(piece)
            sides.append(spans)
        whole = (" " + (text or "")).encode()
        yield sides if all(b"".join(s[3] for s in side) == whole for side in sides) else ([], [])


def expected(texts):
    counts, found = Counter(), []
    for a, b in tokens_of(texts):
        links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
        counts.update(links)
        ends = sorted({x[1] for x in a} & {y[1] for y in b})
        groups = []
        for start, stop in zip([0, *ends], ends, strict=False):
            groups.append("|".join(",".join(str(x[2]) for x in side if start <= x[0] < stop) for side in (a, b)))
        found.append((len(a), len(b), links, ";".join(groups), len(groups)))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [
        (n_a, n_b, n_groups, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), text)
        for n_a, n_b, links, text, n_groups in found
    ]


def aligned(spark, texts, **more):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, bundle string").repartition(3)
    rows = align_tokens(df, with_groups=True, **more).orderBy("doc_id").collect()
    assert all(r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in rows)
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in rows]


def test_equals_all_pairs_of_ranges(spark):
    assert aligned(spark, TEXTS) == expected(TEXTS)


def test_many_bundles_and_parts(spark, monkeypatch):
    """Small bundles and parts give the same counts."""
    texts = [t for t in TEXTS if t] + [words(i, 40 + 7 * i) for i in range(30)]
    with monkeypatch.context() as small:
        small.setattr(alignment, "BUNDLE_BYTES", 500)
        small.setattr(alignment, "BATCH_BYTES", 300)
        got = aligned(spark, texts)
    assert got == expected(texts)


def test_sums_of_many_links_in_slices(spark, monkeypatch):
    texts = [words(i, 20 + i) for i in range(12)] + ["", None]
    monkeypatch.setattr(alignment, "SUM_LINKS", 50)
    assert aligned(spark, texts) == expected(texts)


def test_memory_of_a_worker(monkeypatch):
    """A bundle of texts is aligned and numbered in a bounded part of a worker's memory."""
    path = public_tokenizers.path
    paths = (path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), path("piece_bpe_32k.model"))
    monkeypatch.setattr(alignment, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    base = SimpleNamespace(schema={"doc": SimpleNamespace(dataType=LongType())}, mapInArrow=lambda work, _: work)
    work = alignment._aligned(base, paths, False)
    batch = pa.RecordBatch.from_pydict({"doc": list(range(75)), "body": [words(i, 8000) for i in range(75)]})
    assert batch.nbytes > 2.5e6
    list(work(iter([batch.slice(0, 1)])))
    tracemalloc.start()
    rows = sum(b.num_rows for b in work(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 76
    assert peak < 120e6


@pytest.mark.parametrize("text", [words(9, 4000), words(5, 50) + "x" * 3000 + " 👩‍👩‍👧 " + words(6, 500)])
def test_parts_of_a_long_text_join_up(monkeypatch, text):
    path = public_tokenizers.path
    models = ByteEncoder(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken")), PieceModel(path("piece_bpe_32k.model"))
    monkeypatch.setattr(alignment, "PART_CHARS", 100)
    parts = list(_parts(text))
    assert len(parts) > 5 and " ".join(parts) == text
    for model in models:
        assert [i for ids in model.encode(parts) for i in ids] == model.encode([text])[0]


def test_no_piece_reaches_over_a_blank():
    """What cutting between two words rests on."""
    path = public_tokenizers.path
    for pieces in (ByteEncoder(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken")).pieces, PieceModel(path("piece_bpe_32k.model")).pieces):
        assert not [p for p in pieces if b" " in p.lstrip(b" ") and p.lstrip(b" ")[:1].isalpha()]


def test_empty_table_and_null_ids(spark):
    assert aligned(spark, []) == []
    df = spark.createDataFrame([(None, "one two"), (None, "one two"), (3, None)], "doc_id long, text string")
    rows = sorted(map(tuple, align_tokens(df).drop("groups_sha256").fillna(-1).collect()))
    assert rows == [(-1, 2, 2, 2, 2, 2, 4), (-1, 2, 2, 2, 2, 2, 4), (3, 0, 0, 0, 0, 0, 0)]
    assert align_tokens(df.filter(F.lit(False))).columns[0] == "doc_id"
