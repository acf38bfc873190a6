"""Decontamination, fill-in-middle and source divergence against plain Python, with the edges of each."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from procurelake.llm import decontaminate, divergence, fill_middle

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [m.group() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))]


# decontamination


def plain_hits(texts, items, window=10):
    """(number of words, hit places, item names) of each text, window by window."""
    out = []
    for t in texts:
        w = words(t)
        hit, names = set(), set()
        for name, it in items:
            x = words(it)
            k = min(window, len(x))
            for i in range(len(x) - k + 1) if x else ():
                for j in range(len(w) - k + 1):
                    if w[j : j + k] == x[i : i + k]:
                        hit |= {*range(j, j + k)}
                        names |= {str(name)} - {"None"}
        out.append((len(w), hit, sorted(names)))
    return out


def shared_texts():
    rng = random.Random(8)
    vocabulary = ["Ab", "c", "dé", "42", "x9", "ÄÖ", "the", "z" * 70, "Z" * 69 + "y"]
    some = lambda n: rng.choice([" ", ", ", "\n", "_-"]).join(rng.choices(vocabulary, k=n))
    items = [(i, some(rng.choice([1, 2, 9, 10, 11, 30]))) for i in range(12)] + [(90, None), (91, ""), (92, "-- !"), (None, some(14)), (10, some(12))]
    items += [items[3], (200, items[4][1])]
    texts = [None, "", "...", some(400)]
    for _ in range(60):
        parts = [some(rng.randint(0, 8)), rng.choice(items)[1] or "", some(rng.randint(0, 6)), (rng.choice(items)[1] or "").upper()]
        texts.append(" ".join(parts))
    return texts, [(n, t) for n, t in items if len(words(t)) != 1 or rng.random() < 0.5]


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 60])
def test_hits_against_plain_windows(spark, block_words):
    texts, items = shared_texts()
    df = spark.createDataFrame([(i, t, "row") for i, t in enumerate(texts)] + [(5, texts[5], "row")], "doc_id long, text string, `Row` string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan_benchmark(df, benchmark, block_words=block_words).collect()
    assert sorted(r.doc_id for r in got) == sorted([*range(len(texts)), 5]) and {r["Row"] for r in got} == {"row"}
    want = plain_hits(texts, items)
    for r in got:
        n, hit, names = want[r.doc_id]
        assert r.n_words == n and [*r["items"]] == names
        assert {i for s in r.spans for i in range(s.first, s.last)} == hit
        assert all(a.last < b.first for a, b in zip(r.spans, r.spans[1:], strict=False))
        for s in r.spans:
            assert words(texts[r.doc_id][s.start : s.end]) == words(texts[r.doc_id])[s.first : s.last]
    assert sum(len(r.spans) > 0 for r in got) > 20


def test_contamination_is_removed(spark):
    item = "one two three four five six seven eight nine ten eleven"
    texts = [f"Before, {item.upper()}! after", "nothing here", None, item, "é " + item + " é " + item]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({n: F.lit(n) for n in ("spans", "Items", "n.words")})
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(df, benchmark).collect()}
    assert cut == {0: "Before, ! after", 1: "nothing here", 2: None, 3: "", 4: "é  é "}
    kept = decontaminate.decontaminate(df, benchmark, remove="documents")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2] and kept.columns == df.columns
    assert sorted(r.doc_id for r in decontaminate.decontaminate(df, benchmark, remove="documents", share=0.9).collect()) == [0, 1, 2]
    assert decontaminate.decontaminate(df, benchmark.limit(0)).where("text = 'nothing here'").count() == 1
    assert decontaminate.decontaminate(df.limit(0), benchmark).count() == 0
    with pytest.raises(ValueError):
        decontaminate.decontaminate(df, benchmark, remove="both")


def test_long_texts_are_cut_between_words(monkeypatch):
    from procurelake.llm import words as W

    monkeypatch.setattr(W, "CHUNK_BYTES", 7)
    text = ("ab cde fghijklmnop q  " * 9).encode()
    parts = list(W.chunks(text, decontaminate.TABLE))
    assert len(parts) > 9 and [w for p in parts for w in p.split()] == text.split()


# fill in middle


def plain_cut(doc_id, text, unit):
    t, said = text or "", "" if doc_id is None else str(doc_id)
    units = [m.group() for m in re.finditer(f"{unit}|.", t, re.S)] if unit else list(t)
    d = hashlib.sha256(f"1:{said}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", [None, r"[a-z]+", r"[^\n]*\n"])
def test_cuts_against_plain_python(spark, unit):
    rng = random.Random(3)
    pool = ["a", "b", "é", "ﬀ", "😀", "\n", "<", ">", "P", "<S", "M>", "ab", "中", " "]
    texts = [None, "", "x", "<P>", "a<S>b", "<", "😀", "<P", "S>"] + ["".join(rng.choices(pool, k=rng.choice([1, 5, 39, 40, 41, 80, 300, 2000]))) for _ in range(80)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (None, None, "x"), (12, texts[12], "x"), (12, texts[13], "x"), (None, "no id", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `Sha` string").repartition(3)
    made = fill_middle.fill_in_middle(df, **({"unit": unit} if unit else {}))
    got = made.withColumn("back", fill_middle.restored(F.col("fim.output"), F.col("fim.form"))).collect()
    want = Counter(((i, t, s), plain_cut(i, t, unit)) for i, t, s in rows)
    assert Counter(((r.doc_id, r.text, r["Sha"]), tuple(r.fim)) for r in got) == want
    assert all(r.back == (r.text or "") for r in got)
    assert {r.fim.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(df.limit(0)).count() == 0


# source divergence


def plain_divergence(rows, min_docs, top):
    clean = [((x or ""), (lang or ""), (source or "")) for x, lang, source in rows]
    cut = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(UPPER))) for t, lang, source in clean]
    out = []
    for lang in {c[0] for c in cut}:
        df = Counter(w for k, _, ws in cut if k == lang for w in set(ws))
        kept = sorted(w for w, n in df.items() if n >= min_docs)
        count = {s: Counter(w for k, x, ws in cut if (k, x) == (lang, s) for w in ws if w in kept) for s in {x for k, x, _ in cut if k == lang}}
        v = len(kept)
        share = lambda c, w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * v)
        whole = sum(count.values(), Counter())
        for s, c in count.items():
            pairs = sorted((-sum(abs(share(c, w) - share(o, w)) for w in kept), x.encode()) for x, o in count.items() if x != s)
            terms = sorted((share(whole, w) - share(c, w), w.encode()) for w in kept if c[w] and share(c, w) > share(whole, w))[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


def test_divergence_against_plain_python(spark, monkeypatch):
    rng = random.Random(2)
    long = ["q" * 64, "q" * 65, "Q" * 200, "é" * 40]
    vocabulary = [f"w{'abcdefgh'[i % 8]}{'xyz'[i % 3]}" for i in range(24)] + ["É", "naïve", "n", "x-y", "a1b", *long]
    rows = []
    for i in range(240):
        lang, source = rng.choice(["en", "fr", None, ""]), rng.choice([None, "s1", "s2", "s3", "s4", "Ä", "s5"])
        own = vocabulary[len(source or "") :: 2] if rng.random() < 0.5 else vocabulary
        rows.append((rng.choice([", ", "  ", "\n", " 7 "]).join(rng.choices(own, k=rng.randint(0, 12))), lang, source))
    rows += [rows[0]] * 3 + [(None, "en", "only null"), ("few words", "de", "s1"), ("", "de", "s2"), ("alone", "it", "s")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, `count` int, gid int").repartition(3)
    want = plain_divergence(rows, 8, 5)
    got = sorted(map(tuple, divergence.source_divergence(df, min_docs=8, top_terms=5).collect()))
    assert got == want and len({r[2] for r in got}) == 2 and any(r[4] == 0 for r in got)
    # small blocks, cells and broadcasts change nothing
    for name, value in (("CELL_SOURCES", 2), ("CELL_TERMS", 3), ("LEAST_CELLS", 1), ("BROADCAST_BYTES", -1), ("HELD", 5)):
        monkeypatch.setattr(divergence, name, value)
    assert sorted(map(tuple, divergence.source_divergence(df, min_docs=8, top_terms=5, block_terms=30).collect())) == want
    assert divergence.source_divergence(df.limit(0)).count() == 0
    # counts far beyond 64 bits of product are exact
    big = spark.range(1).select(divergence.share(F.lit(3_000_000_000_000_001), F.lit(7_000_000_000_000_003), F.lit(11)).alias("p")).first().p
    assert big == 1 + 10**9 * (3_000_000_000_000_001 + 5) // (7_000_000_000_000_003 + 55)
