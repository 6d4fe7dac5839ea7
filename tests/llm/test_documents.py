"""The operators on documents against brute force, on awkward rows."""

import hashlib
import math
import re
import struct
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewfold.llm import near_dup, ngram_model
from reviewfold.llm.bundles import BUNDLE_BYTES, Words
from reviewfold.llm.common import crc_mod
from reviewfold.llm.content_sort import content_groups, drop_copies
from reviewfold.llm.near_dup import near_duplicates
from reviewfold.llm.ngram_model import score_texts
from reviewfold.llm.packing import pack, plan_best_fit
from reviewfold.llm.pieces import load_tokenizer, tokenizer_path
from reviewfold.llm.shards import jump_hash, shard_documents
from reviewfold.llm.spans import drop_repeated_spans, sentences
from reviewfold.llm.token_counts import token_counts
from reviewfold.llm.word_table import encode_round_trip
from tests.llm.samples import CLASHING, awkward_rows, documents

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def by_id(df):
    found = defaultdict(list)
    for row in df.collect():
        found[row.doc_id].append(row)
    return found


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).repartition(3).cache()


def test_content_groups(docs):
    result = content_groups(docs).collect()
    groups = defaultdict(list)
    for i, text in awkward_rows():
        groups[re.sub(SPACE, "", text or "")].append((-len(text or ""), i is None, i or 0, i))
    assert len(result) == len(awkward_rows())
    expected = Counter()
    for norm, members in groups.items():
        keep = min(members)[3]
        for *_, i in members:
            expected[i, keep, len(members), hashlib.sha256(norm.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in result) == expected
    assert Counter(r.text_sha256 for r in result if r.kept) == Counter(hashlib.sha256(n.encode()).hexdigest() for n in groups)


def test_hot_group_over_many_partitions(spark, monkeypatch):
    from reviewfold.llm import content_sort

    monkeypatch.setattr(content_sort, "PARTITION_BYTES", 200)
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(300)]
    result = content_groups(documents(spark, rows)).collect()
    hot = [r for r in result if r.group_size > 1]
    assert len(hot) == 200 and {r.keep_id for r in hot} == {1} and {r.group_size for r in hot} == {200}
    assert [r.doc_id for r in hot if r.kept] == [1]
    assert sum(r.kept for r in result) == 101


def test_drop_copies_keeps_columns(docs):
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    texts = Counter(re.sub(SPACE, "", t or "") for _, t in awkward_rows())
    assert Counter(re.sub(SPACE, "", r.text or "") for r in kept.collect()) == Counter(texts.keys())


def test_token_counts(docs):
    tokenizer = load_tokenizer(tokenizer_path("word_bpe_49k.json"))
    expected = Counter()
    for i, text in awkward_rows():
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        expected[i, len((text or "").encode()), n, n > 2048] += 1
    assert Counter(map(tuple, token_counts(docs, 2048).collect())) == expected
    assert Counter(map(tuple, token_counts(docs, 2048, batch_bytes=1).collect())) == expected


def test_encode_round_trip(docs):
    tokenizer = load_tokenizer(tokenizer_path("word_bpe_49k.json"))
    expected = Counter()
    for i, text in awkward_rows():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        digest = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        expected[i, len(ids), digest, hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert Counter(map(tuple, encode_round_trip(docs).collect())) == expected
    outputs = encode_round_trip(docs, outputs=True).filter("doc_id = 1").first()
    assert outputs.ids == tokenizer.encode(awkward_rows()[0][1], add_special_tokens=False).ids


def test_pack(docs):
    tokenizer = load_tokenizer(tokenizer_path("byte_bpe_50k.json"))
    rows = pack(docs, 256).collect()
    expected = Counter()
    for i, text in awkward_rows():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= 256 else len(ids) % 256 or 256
        cuts = [0, *range(first, len(ids) + 1, 256)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[i, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= math.ceil(sum(r.length for r in rows) / 256 * 1.05) + 1


def test_plan_equals_best_fit_over_single_pieces():
    rng = np.random.default_rng(1)
    for capacity in (7, 50, 300):
        lengths = sorted(rng.integers(1, capacity + 1, 400).tolist(), reverse=True)
        rooms: list[int] = []
        for n in lengths:
            fits = [r for r in range(len(rooms)) if rooms[r] >= n]
            at = min(fits, key=lambda r: rooms[r]) if fits else len(rooms)
            if not fits:
                rooms.append(capacity)
            rooms[at] -= n
        plan = plan_best_fit(Counter(lengths), capacity)
        used = Counter()
        for length, _, n, first, _ in plan:
            for s in range(first, first + n):
                used[s] += length
        assert sum(n for _, _, n, _, _ in plan) == 400 and max(used.values()) <= capacity
        assert len(used) == len(rooms)


def test_jump_hash_moves_only_to_the_new_shard():
    keys = np.random.default_rng(2).integers(0, 1 << 63, 20_000).astype(np.uint64)
    for n in (1, 2, 8, 100):
        a, b = jump_hash(keys, n), jump_hash(keys, n + 1)
        assert ((a == b) | (b == n)).all() and set(a) <= set(range(n))
        assert abs((b == n).mean() - 1 / (n + 1)) < 0.02
    # One key at a time, with plain integers.
    for key in map(int, keys[:200]):
        b, j, state = -1, 0, key
        while j < 12:
            b = j
            state = (state * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * (float(1 << 31) / float((state >> 33) + 1)))
        assert jump_hash(np.array([key], np.uint64), 12)[0] == b


def test_shard_documents(docs):
    rows = shard_documents(docs, 8).collect()
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key") for i, t in awkward_rows())
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law) for r in rows) == expected
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len({r.shard for r in rows if r.doc_id == i}) == 1 for i in {r.doc_id for r in rows})


def span_truth(rows, min_words):
    """Every text without the sentences under a run that stands earlier."""
    first, runs, pieces = {}, [], {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        pieces[i, text] = parts = [p.decode() for p in sentences((text or "").encode())]
        ws = [re.findall(WORD, lower(p)) for p in parts]
        found = set()
        for a in range(len(ws)):
            for b in range(a, len(ws)):
                if sum(map(len, ws[a : b + 1])) >= min_words:
                    if ws[a]:
                        found.add((a, b))
                    break
        for b in range(len(ws)):
            for a in range(b, -1, -1):
                if sum(map(len, ws[a : b + 1])) >= min_words:
                    if ws[b]:
                        found.add((a, b))
                    break
        for a, b in sorted(found):
            key = tuple(" ".join(w) for w in ws[a : b + 1] if w)
            runs.append((i, text, a, b, key))
            first.setdefault(key, (i, text, a))
    gone = defaultdict(set)
    for i, text, a, b, key in runs:
        if first[key] != (i, text, a):
            gone[i, text] |= set(range(a, b + 1))
    return {k: "".join(p for n, p in enumerate(v) if n not in gone[k]) for k, v in pieces.items()}, gone


def test_drop_repeated_spans(docs):
    rows = [r for r in awkward_rows() if r[0] not in (6, 7)]
    truth, gone = span_truth(rows, 40)
    found = drop_repeated_spans(docs.filter("doc_id is null or doc_id not in (6, 7)"), min_words=40)
    assert found.columns == [*docs.columns, "n_sentences", "n_removed"]
    texts = Counter()
    for i, text in rows:
        texts[i, truth[i, text] if text is not None else None, len(gone[i, text])] += 1
    assert Counter((r.doc_id, r.text, r.n_removed) for r in found.collect()) == texts
    assert "Something else stands here. And more." == truth[14, dict(rows)[14]]


def test_long_copy_loses_everything(docs):
    found = by_id(drop_repeated_spans(docs.filter("doc_id in (6, 7)")))
    assert found[6][0].n_removed == 0 and found[7][0].text == ""


def test_passage_whose_ends_cut_sentences(spark):
    a, b, c, d = ([f"{k}{i}" for i in range(n)] for k, n in (("a", 21), ("b", 8), ("c", 90), ("d", 21)))
    middle = " ".join(b) + ". " + " ".join(c) + ". "
    short, long = (" ".join(a) + ". " + m + " ".join(d) for m in (" ".join(b) + ". ", middle))
    rows = [
        (1, f"One begins so {short} and goes on."),
        (2, f"Two has another head {short} or another end."),
        (3, f"Three {long} is long."),
        (4, f"Four, also {long} with one more word."),
        (5, "Clean words. " + " ".join(a[:19]) + ". And more."),
    ]
    found = by_id(drop_repeated_spans(documents(spark, rows)))
    assert [found[i][0].n_removed for i in range(1, 6)] == [0, 1, 1, 2, 0]
    assert found[2][0].text == rows[1][1].replace(" ".join(b) + ". ", "")
    assert found[4][0].text == rows[3][1].replace(middle, "")
    assert found[5][0].text == rows[4][1]


def shingles(text, width):
    w = re.findall(WORD, lower(text))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def near_truth(rows, width, threshold):
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return Counter((i, len(s), least.get(root(k), None) if s else i) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(docs, width):
    rows = near_duplicates(docs, width=width).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows) == near_truth(awkward_rows(), width, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_chains_and_a_hot_group_of_near_copies(spark):
    base = [f"w{k}" for k in range(120)]
    rows = [(1000, " ".join(base))]
    for i in range(60):  # each close to the base, many of them far from one another
        copy = list(base)
        for k in range(2):
            copy[(i * 7 + k * 53) % 120] = f"x{i}_{k}"
        rows.append((i, " ".join(copy)))
    step = list(base)
    for i in range(12):  # a chain of small steps
        step = step[3:] + [f"s{i}_{k}" for k in range(3)]
        rows.append((2000 + i, " ".join(step)))
    found = near_duplicates(documents(spark, rows), width=4).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == near_truth(rows, 4, 80)


def test_signatures_within_the_threshold_share_a_bucket():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = rng.integers(0, 256, near_dup.K, dtype=np.uint8)
        b = a.copy()
        at = rng.choice(near_dup.K, near_dup.R, replace=False)
        b[at] ^= rng.integers(1, 256, near_dup.R, dtype=np.uint8)
        keys = near_dup.bucket_keys(np.stack([a, b]))
        assert set(keys[0]) & set(keys[1])


def test_keys_leave_in_small_batches():
    """A batch of classes is keyed without holding all its keys; no meeting is lost."""
    rng = np.random.default_rng(5)
    origins = rng.integers(0, 256, (40, near_dup.K), dtype=np.uint8)
    sig = origins[rng.integers(0, 40, 10_000)]
    sig[rng.random(sig.shape) < 0.1] = 7
    node = rng.permutation(10_000)
    batch = pa.RecordBatch.from_arrays([pa.array(node), pa.array([s.tobytes() for s in sig], pa.binary())], names=["node", "sig"])
    rows, most = [], 0
    tracemalloc.start()
    for out in near_dup._spread(iter([batch])):
        most = max(most, out.num_rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most <= 10_000 * 6 and peak < 16 << 20
    rows = [r for out in near_dup._spread(iter([batch])) for r in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    buckets = defaultdict(list)
    for n, keys in zip(node.tolist(), near_dup.bucket_keys(sig).view(np.int64).tolist(), strict=True):
        for key in keys:
            buckets[key].append(n)
    expected = set()
    for key, members in buckets.items():
        members = sorted(members)
        expected.add((key, members[0], None, None))
        expected.update((key, n, members[0], before) for before, n in zip(members, members[1:], strict=False))
    assert len(rows) == 10_000 * near_dup.K and set(rows) == expected


def test_score_texts(docs, spark):
    rows = awkward_rows()
    tokens = [[*re.findall(WORD, lower(t)), "\n"] for _, t in rows]
    train = [zlib.crc32(str(i if i is not None else "").encode()) % 5 != 1 for i, _ in rows]
    counts = Counter(w for t, ok in zip(tokens, train, strict=True) if ok for w in t)
    pairs = Counter(p for t, ok in zip(tokens, train, strict=True) if ok for p in zip(["\n", *t], t, strict=False))
    n, v = sum(counts.values()), len(counts)
    p1 = lambda w: (counts[w] + 0.5) / (n + 0.5 * (v + 1))
    expected = defaultdict(list)
    for (i, _), t, ok in zip(rows, tokens, train, strict=True):
        base = sum(math.log10(p1(w)) for w in t)
        mix = ngram_model.MIX
        exact = sum(
            math.log10((1 - mix) * p1(w) + mix * min(pairs[a, w], counts[a]) / counts[a]) if counts[a] else math.log10(p1(w))
            for a, w in zip(["\n", *t], t, strict=False)
        )
        expected[i].append((not ok, len(t), sum(counts[w] > 0 for w in t), base, exact))
    for round_bytes in (ngram_model.ROUND_BYTES, 1):
        found = by_id(score_texts(docs, crc_mod("doc", 5) != 1, round_bytes=round_bytes))
        assert {k: len(x) for k, x in found.items()} == {k: len(x) for k, x in expected.items()}
        for i, mine in found.items():
            ordered = sorted(mine, key=lambda r: (r.n_tokens, r.base_score))
            for r, (held, size, known, base, exact) in zip(ordered, sorted(expected[i], key=lambda e: (e[1], e[3])), strict=True):
                assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, size, known, n)
                assert r.base_score == pytest.approx(base)
                # Counts are quantised to powers of two, and a probe may be wrong.
                assert abs(r.score - exact) <= 0.35 * size + 0.5


def test_words_of_a_bundle():
    """Numbered by Arrow as by Python."""
    texts = [(t or "") for _, t in awkward_rows()] + [" Ab  c\x0b\x0cD\r\n\tÀe\x1c\x85 x\x00y ", "\x01 \x08", "a", ""]
    bodies = [t.encode() for t in texts]
    for rows in (bodies, [b""], [b" "], [b"one"]):
        tokens = [[*b.lower().split(), b"\n"] for b in rows]
        found, plain = Words.lower_cased(pa.array(rows, pa.binary()), b"\n"), Words(iter(tokens))
        assert found.distinct == plain.distinct
        assert found.codes.tolist() == plain.codes.tolist() and found.codes.dtype == plain.codes.dtype
        assert found.sizes.tolist() == plain.sizes.tolist()


def test_lookups_stop_at_the_first_bit_that_is_missing(monkeypatch):
    """A bigram that was not entered costs about two of the five bits, not all."""
    rng = np.random.default_rng(3)
    pairs = rng.integers(0, 1 << 47, 40_000, dtype=np.uint64)
    table = {"high": (pairs >> np.uint64(32)).astype(np.uint16), "low": (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)}
    blob = ngram_model.pack_table(pa.table({k: pa.array(v) for k, v in table.items()} | {"n": pa.array(np.ones(40_000, np.int64))}))
    built = ngram_model._segment(pa.table({"segment": pa.array([0], pa.int32()), "blob": pa.array([blob], pa.binary())}))
    bits, raw = built.column("bits")[0].as_py(), np.frombuffer(built.column("raw")[0].as_py(), np.uint8)

    class Counted(np.ndarray):
        reads = 0

        def __getitem__(self, at):
            Counted.reads += np.size(at)
            return np.asarray(super().__getitem__(at))

    model = ngram_model.Filter(1, {0: (bits, raw.view(Counted))})
    assert (model.counts(pairs) >= 1).all()
    Counted.reads = 0
    absent = rng.integers(0, 1 << 47, 40_000, dtype=np.uint64)
    model.counts(absent)
    assert Counted.reads < 3 * len(absent)


def test_quantised_counts_never_miss_an_entry():
    rng = np.random.default_rng(4)
    pairs = np.unique(rng.integers(0, 1 << 47, 5000).astype(np.uint64))
    counts = rng.integers(1, 1000, len(pairs))
    import pyarrow as pa

    blob = ngram_model.pack_table(
        pa.table(
            {
                "high": pa.array((pairs >> np.uint64(32)).astype(np.uint16)),
                "low": pa.array((pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)),
                "n": pa.array(counts.astype(np.int64)),
            }
        )
    )
    row = ngram_model._segment(pa.table({"segment": pa.array([0], pa.int32()), "blob": pa.array([blob], pa.binary())}))
    raw = np.frombuffer(row.column("raw")[0].as_py(), np.uint8)
    model = ngram_model.Filter(1, {0: (row.column("bits")[0].as_py(), raw)})
    level = model.counts(pairs)
    assert (level >= 1 + np.floor(np.log2(counts))).all()
    others = np.setdiff1d(rng.integers(0, 1 << 47, 20_000).astype(np.uint64), pairs)
    assert (model.counts(others) > 0).mean() < 0.06


OPERATORS = {
    "content_groups": content_groups,
    "drop_copies": drop_copies,
    "token_counts": lambda d: token_counts(d, 10),
    "encode_round_trip": encode_round_trip,
    "pack": pack,
    "shard_documents": lambda d: shard_documents(d, 3),
    "drop_repeated_spans": drop_repeated_spans,
    "near_duplicates": near_duplicates,
    "score_texts": lambda d: score_texts(d, F.lit(True)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](documents(spark, [])).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_only_null_texts(spark, name):
    rows = OPERATORS[name](documents(spark, [(1, None), (None, None), (1, None)])).collect()
    assert len(rows) == (1 if name == "drop_copies" else 3)


def test_threshold_below_the_radius_is_an_error(docs):
    with pytest.raises(ValueError, match="threshold"):
        near_duplicates(docs, threshold=60)


def test_constants_hold():
    assert BUNDLE_BYTES > 0 and len(set(CLASHING)) == len(CLASHING)
    assert 2 * near_dup.CHUNKS > near_dup.R
