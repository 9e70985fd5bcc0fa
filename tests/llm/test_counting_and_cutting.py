"""Spelling variants, source divergence and concatenation against brute force."""

import math
import os
import re
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("marketsig.llm")
from marketsig.llm import concat, divergence, variants  # noqa: E402
from marketsig.llm.common import table  # noqa: E402

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, word string, value double, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "w", 0.5, "r") for r in rows], DOCS)


def odd_rows():
    words = ["colour", "colours", "colourss", "kolours", "coolours", "colourt", "ÀÉÎcolour", "Àéîcolour", "aaaaaaaa", "aaaaaaaaa", "aaaaaaab",
             "straße×÷ng", "straßeng"]
    rows = [(i, " ".join(w for k, w in enumerate(words) if (i * 7 + k) % (k + 2) < 2) + " Colours COLOURS" * (i % 5), "en" if i % 3 else None, f"s{i % 4}")
            for i in range(60)]
    rows += [(None, "colours kolours", "en", None), (100, None, "de", "x"), (101, "", "de", "y"), (102, " \n\t", "fr", "only"),
             (5, rows[5][1], "en", "s1"), (5, rows[5][1], "en", "s1"), (103, "long text words " * 30_000, "en", "s0"),
             (104, "unbroken" * 200_000, "en", "s2"), (105, "日本語 \x1c é\x85ü 🙂", "en", "s2")]
    return rows


def brute_variants(rows, times=10, least=2):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= least}
    by_hole = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            by_hole[w[:i] + "\0" + w[i + 1:]].add(w)
    near = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            near[w] |= by_hole[w[:i] + "\0" + w[i + 1:]] - {w}
            if (u := w[:i] + w[i + 1:]) in counts:
                near[w].add(u)
                near[u].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= times * counts[w]:
            form[w] = best
    out = {}
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None)
    return out


def test_variants_equal_brute_force(spark):
    small = [(r.doc_id, r.text, r.lang, r.source) for r in table(spark, SMALL, "documents").collect()]
    for rows in (odd_rows(), small + odd_rows()):
        want = brute_variants([r[:2] for r in rows])
        got = variants.variants(frame(spark, rows)).collect()
        assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)
        assert any(v[0] for v in want.values()) and any(v[3] > 1 for v in want.values())
    assert variants.variants(frame(spark, odd_rows()).limit(0)).count() == 0


def test_variants_follow_chains(spark):
    chain = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "zbcdefg": 19}
    rows = [(i, w, "en", "s") for w, n in chain.items() for i in [_id(w)] for _ in range(n)]
    got = {r.word: r for r in variants.variants(frame(spark, rows)).collect()}
    assert got["abcdefg"].form == "abcdefgh" and {got[w].root for w in list(chain)[:4]} == {"abcdefghij"}
    assert got["zbcdefg"].form is None and got["zbcdefg"].root == "zbcdefg" and got["zbcdefg"].n_near == 1


def _id(word):
    return next(i for i in range(1000) if zlib.crc32(f"{i}:{word}".encode()) % 31)


def test_variant_groups_that_span_batches(spark):
    words = [(f"{a}bcdefgh{b}", 2 + k) for k, (a, b) in enumerate((a, b) for a in "abcdefghijklmnop" for b in "qrstuvwxyz")]
    want = {w: (len({x for x, _ in words if x != w and sum(c != d for c, d in zip(w, x)) == 1})) for w, _ in words}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
        got = variants.neighbours(spark.createDataFrame(words, "word string, n long")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r.word: r.n_near for r in got} == want


def brute_audit(rows, least=10, top=10):
    rows = [tuple(x or "" for x in r) for r in rows]
    said = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)) for t, _, _ in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        own = [i for i, r in enumerate(rows) if r[1] == lang]
        df = Counter(w for i in own for w in set(said[i]))
        kept = sorted((w for w, n in df.items() if n >= least), key=str.encode)
        counts = {s: Counter() for s in {rows[i][2] for i in own}}
        for i in own:
            counts[rows[i][2]].update(said[i])
        counts = {s: [c[w] for w in kept] for s, c in counts.items()}
        whole = [sum(c) for c in zip(*counts.values())]

        def shares(c):
            return [1 + 10**9 * (n + 2) // (sum(c) + 2 * len(kept)) for n in c]
        p = {s: shares(c) for s, c in counts.items()}
        q = shares(whole)
        for s in counts:
            pairs = sorted((-sum((x - y) ** 2 // (x + y) for x, y in zip(p[s], p[o])), o.encode(), o) for o in counts if o != s)
            out |= {(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)}
            terms = sorted((-((x - y) ** 2 // (x + y)), w.encode(), w) for x, y, w, n in zip(p[s], q, kept, counts[s]) if n and x > y)
            out |= {(lang, s, "term", w, -v, k) for k, (v, _, w) in enumerate(terms[:top], 1)}
    return out


def test_divergence_equals_brute_force(spark):
    small = [(r.doc_id, r.text, r.lang, r.source) for r in table(spark, SMALL, "documents").collect()]
    tight = divergence.Settings(shard=7, broadcast_bytes=4_000, held=50, cells=100)
    for rows, settings in ((odd_rows(), divergence.Settings()), (small + odd_rows(), divergence.Settings()), (small + odd_rows(), tight)):
        want = brute_audit([r[1:] for r in rows])
        got = divergence.audit(frame(spark, rows), settings).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert divergence.audit(frame(spark, odd_rows()).limit(0)).count() == 0


def test_transducer_gives_places_and_is_minimal():
    terms = sorted({w.encode() for w in "a aa ab abc b ba bc c ca cab cat cats bat bats rat rats straße éa é 日本".split()})
    machine = divergence.Transducer.from_bytes(divergence.Transducer.build(terms).to_bytes())
    assert machine.ordinals(terms).tolist() == list(range(len(terms)))
    assert set(machine.ordinals([b"x", b"cat\xc3", b"ats", b"ra", b"catss", "日".encode()]).tolist()) == {-1}

    def suffixes(prefix):
        return frozenset(t[len(prefix):] for t in terms if t.startswith(prefix))
    assert len(machine.final) == len({suffixes(t[:k]) for t in terms for k in range(len(t) + 1)})
    empty = divergence.Transducer.from_bytes(divergence.Transducer.build([]).to_bytes())
    assert empty.ordinals([b"a"]).tolist() == [-1]


def test_shares_stay_exact_for_large_counts(spark):
    import numpy as np
    total = 9 * 10**15
    for n in (0, 1, 2, 12345678901, total // 3, total):
        want = 1 + 10**9 * n // total
        assert divergence.shares(np.array([n]), np.array([total]))[0] == want
        assert spark.sql(f"select {divergence.share(f'{n}L', f'{total}L')} as p").first().p == want


def test_concatenation_equals_the_tokenizer(spark):
    import numpy as np
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(concat.Settings().tokenizer)
    rows = [r for r in odd_rows() if r[0] != 104] + [(200, "a<|endoftext|>b <|startoftext|>\r\nIt's İstanbul ΣΑΣ é ́x ﬁ 12345 ...", "en", "s"),
                                                     (201, "\x1c\x1d a\xa0b c​d\x85e", "en", "s")]
    rows += [(1000 + r.doc_id, r.text, r.lang, r.source) for r in table(spark, SMALL, "documents").collect()]
    want = {}
    for d, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.setdefault(d, Counter())[ids.tobytes()] += 1
    for settings in (concat.Settings(), concat.Settings(capacity=64, memo=10, block=2, broadcast_tasks=0)):
        got = concat.pack(frame(spark, rows).repartition(7), settings).collect()
        ids_of = {d: [np.frombuffer(x, "<u4") for x in c] for d, c in want.items()}
        for r in got:
            assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start: r.start + r.length].tobytes()) == r.ids_crc32 for x in ids_of[r.doc_id])
        for d, c in want.items():  # every id once
            cover = Counter(at for r in got if r.doc_id == d for at in range(r.start, r.start + r.length))
            assert cover == Counter(at for x, n in c.items() for at in range(len(x) // 4) for _ in range(n))
        filled = {}
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == filled.get(r.sequence_id, 0)
            filled[r.sequence_id] = r.offset + r.length
        total = sum(r.length for r in got)
        short = [n for n in filled.values() if n < settings.capacity]
        assert max(filled.values()) == settings.capacity and len(filled) - len(short) == total // settings.capacity
        assert all(n & n - 1 == 0 for n in short) and len(short) <= math.log2(settings.capacity)
        cuts = {(r.sequence_id, r.doc_id, r.start) for r in concat.boundaries(spark.createDataFrame(got)).collect()}
        assert cuts == {(r.sequence_id, r.doc_id, r.start) for r in got if r.offset == 0 and r.start > 0}
    assert concat.pack(frame(spark, odd_rows()).limit(0)).count() == 0


def test_one_long_labelled_text_does_not_empty_a_dictionary():
    from marketsig.llm import quality

    s = quality.Settings(sample_bytes=60_000)
    rest = [f"the {i} quiet harbour keeps its boats {i * 7919 % 101} and ropes" for i in range(800)]
    assert quality._dictionary(["x" * 70_000, *rest], s) == quality._dictionary(rest, s) != quality._dictionary([], s)
