"""Source divergence against the definition, with a dense table of all terms."""

import random
import re
from collections import Counter, defaultdict

import pytest

from reviewfold.llm import divergence
from reviewfold.llm.divergence import source_divergence, term_counts

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text):
    return [re.sub("[A-Z]+", lambda m: m.group().lower(), w) for w in TERM.findall(text or "")]


def expected(rows, least=3, top=200):
    total, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = Counter(words_of(text))
        total[lang or "", source or ""].update(found)
        docs[lang or ""].update(found.keys())
    out = []
    for lang in {k[0] for k in total}:
        kept = [w for w, n in docs[lang].items() if n >= least]
        groups = {s: c for (k, s), c in total.items() if k == lang}

        def shares(count):
            n = sum(count[w] for w in kept)
            return {w: 1 + 10**9 * (count[w] + 1) // (n + len(kept)) for w in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(sum(groups.values(), Counter()))
        for s in groups:
            parts = {
                "pair": [(t, sum((p[s][w] - p[t][w]) ** 2 // p[t][w] for w in kept)) for t in groups if t != s],
                "term": [(w, (p[s][w] - q[w]) ** 2 // q[w]) for w in kept if groups[s][w] and p[s][w] > q[w]],
            }
            for part, items in parts.items():
                ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(ordered, 1) if part == "pair" or r <= top]
    return sorted(out)


def found(spark, rows, **more):
    df = spark.createDataFrame([(t, a, b, 1) for t, a, b in rows], "text string, lang string, source string, term int")
    return sorted(map(tuple, source_divergence(df, **more).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_definition(spark, monkeypatch, seed):
    monkeypatch.setattr(divergence, "FLUSH_ENTRIES", 50)
    monkeypatch.setattr(divergence, "PART_BYTES", 64)
    monkeypatch.setattr(divergence, "PAIRS_AT_ONCE", 7)
    rng = random.Random(seed)
    names = [f"w{'abcdefghij'[i % 10]}{'xyzé'[i // 10]}" for i in range(40)] + ["Ünder", "ÜNDER", "Don", "don", "中文"]
    rows = []
    for _ in range(150):
        picked = rng.choices(names, weights=[1 / (i + 1) for i in range(len(names))], k=rng.randint(0, 40))
        text = "".join(w + rng.choice([" ", ", ", "-", "'", "\n", "\x00", "3", "\x7f"]) for w in picked)
        source = rng.choices(["a", "b", "c", "d", None], weights=[6, 1, 1, 1, 1])[0]
        rows.append((text, rng.choice(["en", "fr", None]), source))
    rows += [(None, "en", "empty"), ("", "xx", "one"), ("once twice", "xx", "two"), (" 12 ", None, "")] + rows[:10]
    assert found(spark, rows) == expected(rows)
    assert found(spark, rows, min_documents=1, top_terms=3) == expected(rows, 1, 3)


def test_long_text_empty_table_and_columns(spark):
    rows = [("Long " * 30_000 + "tail", "en", "a"), ("long tail", "en", "b"), ("x" * 100_000, "en", "a"), ("long", "en", "b")]
    assert found(spark, rows, min_documents=1) == expected(rows, 1)
    assert found(spark, []) == []


def test_exact_beyond_the_product_of_64_bits(spark):
    from pyspark.sql import functions as F

    rows = [(0, 7), (10**13, 3 * 10**13), (6, 7), (123456789012, 999999999989)]
    df = spark.createDataFrame(rows, "n long, total long")
    got = [r[0] for r in df.select(divergence._probability(F.col("n"), F.col("total"))).collect()]
    assert got == [1 + 10**9 * (n + 1) // total for n, total in rows]


def test_terms_of_bytes():
    assert term_counts("Ab-aB É\tÉ9é".encode()) == Counter({b"ab": 2, "É".encode(): 2, "é".encode(): 1})
