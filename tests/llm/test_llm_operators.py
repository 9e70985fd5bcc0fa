"""Corpus operators against brute force on small tables with nulls, empties, ties and repeats."""

import hashlib
import json
import os
import zlib
from base64 import b32encode
from collections import Counter

import pytest

pytest.importorskip("marketsig.llm")
from marketsig.llm import (chat, decontaminate, extract, fingerprints, jaccard, lines, packing, quality,  # noqa: E402
                           toxicity, warc)
from marketsig.llm.common import table  # noqa: E402

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    base = " ".join(f"tok{i}" for i in range(120))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "two words"), (7, long), (8, long + " end"),
            (9, base), (10, base.replace("tok60", "new")), (11, base.replace("tok60", "new").replace("tok10", "x")),
            (12, base), (12, base), (None, base), (13, "Émile a A a"), (14, "<|endoftext|> <s> </s>")]
    return spark.createDataFrame([(d, t, None, None, None, 9.0, "k") for d, t in rows], DOCS)


def test_toxicity_learns_and_handles_odd_rows(spark, odd):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    got = {r.doc_id: r for r in toxicity.op1(docs, labels).collect()}
    assert len(got) == docs.count()
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(odd, model)
    assert scored.count() == odd.count() and set(scored.columns) == {*odd.columns, "predicted"}
    unfitted = toxicity.op1(odd, labels.limit(0)).collect()
    assert {r.score for r in unfitted} == {0.0}
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_toxicity_held_out_accuracy(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    rows = toxicity.op1(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.97


def test_quality_held_out_accuracy_and_odd_rows(spark, odd):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    rows = quality.op9(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    got = quality.op9(odd, labels.limit(0))
    assert got.count() == odd.count() and {r.score for r in got.collect()} == {0.0}


def test_decontamination_equals_brute_force(spark, odd):
    docs, items = table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark")
    n = 5

    def shingles(text, words=n):
        import re
        w = re.findall(r"[0-9a-z_\u0080-\U0010ffff]+", (text or "").lower())
        return {tuple(w[i:i + min(words, len(w))]) for i in range(len(w) - min(words, len(w)) + 1)} if w else set()

    want = set()
    for d in docs.collect():
        s = shingles(d.text)
        for i in items.collect():
            q = shingles(i.text)
            if q and len(q & s) / len(q) >= 0.8:
                want.add((d.doc_id, i.item_id))
    for block in (20_000, 7):
        got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items, decontaminate.Settings(block=block)).collect()}
        assert got == want and want
    extra = spark.createDataFrame([(1, None), (2, ""), (3, "ONE!"), (4, " ".join(f"tok{i}" for i in range(30, 45)))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(odd, extra).collect()}
    assert got == {(4, 3), (5, 3), (9, 4), (10, 4), (11, 4), (12, 4), (None, 4)}
    assert decontaminate.matches(odd, extra.limit(0)).count() == 0
    assert {r.doc_id for r in decontaminate.clean(odd, extra).collect()} == {1, 2, 3, 6, 7, 8, 13, 14, None}


def _brute_components(rows):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i:i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def test_jaccard_join_equals_brute_force(spark, odd):
    small = table(spark, SMALL, "documents").select("doc_id", "text")
    edits = [(10_000 + i, " ".join(f"z{j}" if (j * 7 + i) % 61 else f"e{i}" for j in range(200))) for i in range(25)]
    docs = small.unionByName(odd.select("doc_id", "text").filter("doc_id is not null").withColumn("doc_id", odd.doc_id + 5000)
                             ).unionByName(spark.createDataFrame(edits, "doc_id long, text string"))
    want = _brute_components([(r.doc_id, r.text) for r in docs.collect()])
    got = jaccard.linked_groups(docs).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    left = jaccard.one_of_each(odd)
    assert left.columns == odd.columns
    assert {r.doc_id for r in left.collect()} == {1, 2, 3, 4, 6, 7, 9, 11, 13, 14, None}  # "tok10" also begins tok100 to tok109
    assert jaccard.linked_groups(odd.limit(0)).count() == 0


def test_parity_sketch_bounds_the_difference():
    import numpy as np
    rng, s = np.random.default_rng(1), jaccard.Settings()
    for n, m, k in ((50, 60, 40), (500, 300, 200), (5000, 70, 10), (1, 1, 0)):
        shared = rng.integers(0, 1 << 63, k, dtype=np.uint64)
        a, b = (np.unique(np.append(shared, rng.integers(0, 1 << 63, x - k, dtype=np.uint64))) for x in (n, m))
        assert jaccard.least_difference(jaccard.parity(a, s), jaccard.parity(b, s)) <= len(np.setxor1d(a, b))


def test_line_dedup(spark):
    base = "the quick brown fox jumps over the lazy dog while many other animals look on and say nothing at all about it " * 3
    rows = [(1, f"{base}\nunique one\n\nHello, World 12!"), (2, f"hello world 99\n{base}"), (3, base.replace("lazy dog", "lazy dig")),
            (4, None), (5, ""), (6, "\n\n"), (None, "unique one"), (7, "unique two"), (8, "!!!")]
    docs = spark.createDataFrame([(d, t, None, None, None, 1.0, "k") for d, t in rows], DOCS)
    got = {(r.doc_id, r.line): (r.keeper_doc_id, r.keeper_line, r.kept) for r in lines.line_groups(docs).collect()}
    assert got[2, 0] == (1, 3, False) and got[2, 1] == (1, 0, False) and got[1, 2] == (1, 2, True)
    assert got[None, 0][2] and got[8, 0][2] and got[4, 0][2] and len(got) == 4 + 2 + 1 + 1 + 1 + 3 + 1 + 1 + 1
    left = {r.doc_id: r.text for r in lines.dedup(docs).collect()}
    assert 2 not in left and left[1] == rows[0][1] and left[4] is None and left[6] == "\n\n"
    assert lines.dedup(docs).columns == docs.columns and lines.dedup(docs.limit(0)).count() == 0
    clash = docs.selectExpr("*", "1 as `__cut`", "2 as gone", "3 as OF", "4 as said")
    for settings in (lines.Settings(), lines.EDITS):
        kept = lines.dedup(clash, settings)
        assert kept.columns == clash.columns
        assert {r.doc_id: r.text for r in kept.collect()} == {r.doc_id: r.text for r in lines.dedup(docs, settings).collect()}
    assert lines.line_groups(docs.limit(0), lines.EDITS).count() == 0


def test_line_groups_equal_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    said = {(r.doc_id, i): t for r in docs.collect() for i, t in enumerate((r.text or "").split("\n"))}
    n, key, sim = lines.line_hashes(list(said.values()))
    at = dict(zip(said, zip(n, key.tolist(), sim.tolist())))
    texts = dict(spark.createDataFrame([(json.dumps(k), v) for k, v in said.items()], "k string, v string")
                 .select("k", lines.normalised(lines.F.col("v"))).collect())
    first = {}
    for k in sorted(said):
        if at[k][0]:
            first.setdefault(at[k][1], k)
    classes = sorted(first)
    parent = {c: c for c in classes}

    def root(c):
        while parent[c] != c:
            c = parent[c]
        return c

    def distance(a, b, most):
        if abs(len(a) - len(b)) > most:
            return most + 1
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]
    for i, a in enumerate(classes):
        sa = at[first[a]][2]
        for b in classes[i + 1:]:
            if (sa ^ at[first[b]][2]).bit_count() <= 3 and root(a) != root(b):
                l, r = texts[json.dumps(first[a])], texts[json.dumps(first[b])]
                if distance(l, r, 20 * max(len(l), len(r)) // 100) <= 20 * max(len(l), len(r)) // 100:
                    parent[root(b)] = root(a)
    keeper = {}
    for k in sorted(said):
        if at[k][0]:
            keeper.setdefault(root(at[k][1]), k)
    want = {k: keeper[root(at[k][1])] if at[k][0] else k for k in said}
    got = {(r.doc_id, r.line): (r.keeper_doc_id, r.keeper_line) for r in lines.line_groups(docs).collect()}
    assert got == want


def test_line_groups_find_edits_without_the_simhash(spark):
    import random
    rng = random.Random(7)

    def word():
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    rows = []
    for i in range(200):
        one = [word() for _ in range((7, 12, 20, 35)[i % 4])]
        at = rng.randrange(len(one))
        other = one[:at] + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in one[at])] + one[at + 1:]
        if len(one[at]) * 5 <= len(" ".join(one)):
            rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(other))]
    rows.append((1_000, word()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.keeper_doc_id for r in lines.line_groups(docs, lines.EDITS).collect()}
    assert len(got) == len(rows) and all(k in (d, d - d % 2) for d, k in got.items())
    copies = [d for d, _ in rows if d % 2]
    assert sum(got[d] == d - 1 for d in copies) >= 0.95 * len(copies)


def test_band_members_are_the_classes_that_share_a_key(spark):
    import numpy as np
    base = "one line of ordinary words that many documents repeat with a small change {}"
    texts = [base.format(i) for i in range(30)] + [f"something else entirely number {w}" for w in ("alpha", "beta")] + ["", "!", "x"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)] + [(None, "null id")], "doc_id long, text string")
    n, ids, _ = lines.line_hashes(texts)
    s = lines.EDITS
    said = [i for i in range(len(texts)) if n[i]]
    keys = lines.band_keys(lines.min_hashes([lines.plain_texts(texts)[i] for i in said], s), s)
    together = {}
    for i, own in zip(ids.view(np.int64)[said].tolist(), keys.tolist()):
        for k in own:
            together.setdefault(k, set()).add(i)
    want = {frozenset(v) for v in together.values() if len(v) > 1}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
        got = {}
        for r in lines.band_members(lines.occurrences(docs, s), s).collect():
            got.setdefault(r.key, set()).add(r.id)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {frozenset(v) for v in got.values()} == want and len(got) == len(want)


def test_extraction(spark):
    page = ('<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href="/x">menu</a></ul></nav>'
            '<div class="ad">buy</div><article><h1>Head&amp;line</h1><p><b>First   par<br>t<p>Second &lt;b&gt; &eacute;</p>{}'
            '<div class="comments"><p>nice</p></div></article><aside>side</aside><form>f</form><footer>foot</footer>')
    rows = [(i, f"http://a.example/{i}", page.replace("{}", f"<p>number {i}</p>" * (i % 3))) for i in range(7)]
    rows += [(7, None, None), (8, "http://b.example", ""), (9, "nohost", "plain text"), (10, "http://a.example/z", "<p>loose <i>text</i>"),
             (11, "http://a.example/z", "<<<>>> &amp &#65;")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in extract.extract(pages).collect()}
    assert got[2].text == "Head&line\nFirst par t\nSecond <b> é\nnumber 2\nnumber 2"
    assert got[3].text == "Head&line\nFirst par t\nSecond <b> é"
    assert got[7].text == got[8].text == "" and got[9].text == "plain text" and got[10].text == "loose text"
    assert got[11].text == "<<<>>> & A"
    assert all(r.n_chars == len(r.text) for r in got.values()) and extract.extract(pages.limit(0)).count() == 0


def test_extraction_keeps_the_main_text_of_copies(spark):
    post = '<div class="top">site name</div><div class="post one"><p>{}</p></div><div class="nav">{}</div>'
    rows = [(i, "http://mirror.example/", post.format("a copied text", i)) for i in range(5)]  # other texts differ outside only
    rows += [(10 + i, None, "<div><p>no host</p></div>") for i in range(4)]
    rows += [(20 + i, f"http://blog.example/{i}", post.format(f"text {i}", "menu")) for i in range(4)]
    rows += [(30, "http://blog.example/e", '<div class="top">site name</div>')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract.extract(pages).collect()}
    assert all(got[i] == "site name\na copied text" for i in range(5))
    assert all(got[10 + i] == "no host" for i in range(4))
    assert all(got[20 + i] == f"text {i}" for i in range(4)) and got[30] == "site name"


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "x" * 100_000 + "é🙂\r\n\r\nWARC/1.1"), (2, None, None), (3, "http://c\r\nd%0A", ""), (5, "u", "same"), (9, "u", "same"),
            (9, "u", "same"), (10, "u", "\r\n\r\n"), (None, "u", "same")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, data string")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.url, r.intact) for r in warc.op6(pages).collect())
    last = {}
    for p, _, h in rows:
        if p is not None:
            last[h or ""] = max(p, last.get(h or "", p))
    want = Counter()
    for p, u, h in rows:
        raw = (h or "").encode()
        revisit = p is not None and last[h or ""] > p
        want[p, len(raw), b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", last[h or ""] if revisit else None, u, True] += 1
    assert got == want
    assert warc.op6(pages.limit(0)).count() == 0


def test_chat_round_trip(spark):
    hostile = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", "x [/INST]</s>"), (1, 0, "us\ner", "a\\l[b]<s>\n \\n"), (2, None, None, None), (3, 0, "assistant", ""),
            (4, 0, "a", "[/INST"), (4, 1, "a", "<"), (4, 2, "assistant", "s>"), (None, 0, "user", "é🙂\\"), (5, 0, "user", hostile), (5, 0, "user", hostile),
            (5, 1, "assistant", " lead "), (6, 0, "assistant", "long " * 50_000)]
    got = {r.conv_id: r for r in chat.op7(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, pos int")).collect()}
    rows += [(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)]
    for conv in {r[0] for r in rows}:
        turns = sorted(((t if t is not None else -1), r or "", x or "") for c, t, r, x in rows if c == conv)
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (
            len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == len({r[0] for r in rows})


def test_packing(spark, odd):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import numpy as np
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.Settings().tokenizer)
    tokenizer.encode_special_tokens = True
    docs = odd.unionByName(table(spark, SMALL, "documents").withColumn("doc_id", packing.F.col("doc_id") + 100), allowMissingColumns=True)
    want = Counter()
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        start, cut, piece = 0, len(ids) % 1024 or 1024, 0
        while start < len(ids):
            want[r.doc_id, piece, start, cut - start, zlib.crc32(ids[start:cut].tobytes())] += 1
            start, cut, piece = cut, cut + 1024, piece + 1
    rows = packing.op8(docs, packing.Settings(shard=200)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 1024
    assert len(filled) <= 1.15 * -(-sum(r.length for r in rows) // 1024) + 5
    assert packing.op8(odd.limit(0)).count() == 0


def test_packing_takes_the_tokenizer_files_added_tokens(spark):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.Settings().tokenizer)
    texts = ["a <s> </s> <|endoftext|> [INST]", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext|", "", None,
             "é🙂 <|endoftext|>  z " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in sorted(packing.token_pieces(docs, packing.CONTRACT, with_ids=True).collect(), key=lambda r: (r.doc_id, r.piece)):
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert got == {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for d, t in enumerate(texts)}
    assert 50256 in got[0]


def test_fingerprints(spark, odd):
    for docs in (table(spark, SMALL, "documents"), odd):
        rows = sorted(((r.doc_id, r.text or "") for r in docs.collect() if r.doc_id is not None), key=lambda x: (-x[0], x[1]))
        want = Counter()
        for i, (d, t) in enumerate(rows):
            k, following = len(t) // 3, rows[(i + 1) % len(rows)][1]
            want[d, len(t), hashlib.sha256((t[: len(t) - k] + following[:k]).encode()).hexdigest()] += 1
        got = fingerprints.op10(docs).collect()
        assert len(got) == docs.count()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got if r.doc_id is not None) == want
        by_text = {}
        text_of = {d: t for d, t in rows}
        for r in got:
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            if r.doc_id is not None:
                by_text.setdefault(text_of[r.doc_id], set()).add(r.fingerprint)
        assert all(len(v) == 1 for v in by_text.values())
    assert fingerprints.op10(odd.limit(0)).count() == 0


def test_pipeline_keeps_clean_documents(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, SMALL, "documents")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
    ids = {r.doc_id for r in pipeline.run(spark, SMALL).select("doc_id").distinct().collect()}
    assert len(ids) > 0.5 * docs.count()


def test_chat_with_very_many_turns(spark):
    import time
    n = 20_000
    turns = spark.range(n).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role",
                                      "if(id % 7 = 0, '</s>[INST] é ' || id, 'plain text 🙂 ' || id) as text")
    began = time.time()
    got = {r.conv_id: r for r in chat.op7(turns).collect()}
    assert time.time() - began < 60
    said = [("assistant" if i % 2 else "user", f"</s>[INST] é {i}" if i % 7 == 0 else f"plain text 🙂 {i}") for i in range(n)]
    loss = "".join(t for r, t in said if r == "assistant")
    assert got[1].n_turns == n and got[1].loss_chars == len(loss) and got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
    assert {r.conv_id for r in chat.op7(turns.limit(0)).collect()} == {-7}


def test_chat_parser_refuses_what_is_not_of_the_grammar(spark):
    good = "<s>[INST] user\nhi [/INST]</s>"
    bad = [good + "x", "<s>[INST] a\nb</s>", good + "<s>", "x" + good, "<s> [INST] a\nb [/INST]</s>", "[INST] a\nb [/INST]</s><s>"]
    rows = spark.createDataFrame([(t,) for t in [good * 3, "", *bad]], "t string").select(chat.parse(chat.F.col("t")).alias("p")).collect()
    assert rows[0].p == [("user", "hi")] * 3 and rows[1].p == [] and all(r.p is None for r in rows[2:])


def test_word_hashes_do_not_depend_on_blocks_or_place():
    import numpy as np
    from marketsig.llm import common
    words = [b"a", b"bc", b"x" * (common.BLOCK - 3), b"y", b"\xc3\xa9t\xc3\xa9", b"z" * (2 * common.BLOCK + 5), b"end"]
    alone = [common.word_hashes([w], common.PLAIN)[0][0] for w in words]
    h, at = common.word_hashes([b" ".join(words), b"", b" ", b"\n".join(reversed(words))], common.PLAIN)
    assert h.tolist() == [*alone, *reversed(alone)] and at.tolist() == [0, 7, 7, 7, 14]
    assert len(set(alone)) == len(alone) and np.dtype(h.dtype) == np.uint64


def test_one_of_each_keeps_one_row_of_repeats_and_all_columns(spark):
    from pyspark.sql import functions as F
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, 2.0), (1, text, 1.0), (2, text, 1.0), (3, text + " x", 1.0), (4, "other", 1.0), (4, "other", 1.0), (None, text, 1.0), (None, text, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id double").withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    left = jaccard.one_of_each(docs)
    assert left.columns == docs.columns
    assert Counter((r.doc_id, r["__id"]) for r in left.collect()) == {(1, 1.0): 1, (4, 1.0): 1, (None, 1.0): 2}


def test_toxic_stage_keeps_columns_named_like_its_own(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, SMALL, "documents").selectExpr("*", "doc_id * 2.5 as score", "'p' as predicted", "1 as toxic")
    left = pipeline.drop_toxic(spark, docs, SMALL)
    assert left.columns == docs.columns and left.filter("score <> doc_id * 2.5 or predicted <> 'p' or toxic <> 1").count() == 0


def test_labelled_sample_has_a_row_an_id(spark):
    from marketsig.llm.common import labelled_sample
    docs = spark.createDataFrame([(1, "b")] * 50 + [(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    assert {tuple(r) for r in labelled_sample(docs, labels, "toxic", 10).collect()} == {(1, "a", 1), (2, "", 0)}


def test_edit_distances_equal_the_table():
    import random
    rng = random.Random(3)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]
    pairs = [("", ""), ("", "abc"), ("abc", ""), ("a" * 64, "a" * 65), ("ab" * 64, "ba" * 64)]
    for size in (1, 5, 63, 64, 65, 130, 200):
        for _ in range(12):
            a = "".join(rng.choice("abcé ") for _ in range(size))
            b = list(a)
            for _ in range(rng.randint(0, size // 2)):
                at = rng.randrange(len(b) + 1)
                b[at: at + rng.randint(0, 2)] = rng.choice(["", "x", "yz"])
            pairs.append((a, "".join(b) if rng.random() < 0.8 else "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 150)))))
    want = [plain(a, b) for a, b in pairs]
    left, right = [a for a, _ in pairs], [b for _, b in pairs]
    assert lines.edit_distances(left, right).tolist() == want
    assert lines.edit_distances(left, right, longest=10).tolist() == want
    assert lines.edit_distances(left, right, alphabet=2, at_once=7).tolist() == want


def test_edit_distances_within_a_limit():
    import random
    rng = random.Random(5)
    left, right = [], []
    for size in (0, 1, 63, 64, 150, 400, 900, 2100):
        for _ in range(40):
            a = [rng.choice("abcdeé ") for _ in range(size)]
            b = a[rng.randint(0, 40):] if rng.random() < 0.7 else [rng.choice("abcdeé ") for _ in range(size)]
            for _ in range(rng.randint(0, size // 3)):
                at = rng.randrange(len(b) + 1)
                b[at: at + rng.randint(0, 2)] = rng.choice([[], ["x"], ["y", "z"]])
            left.append("".join(a))
            right.append("".join(b))
    want = lines.edit_distances(left, right)
    for percent in (0, 3, 20, 60):
        limit = lines.np.array([percent * max(len(a), len(b)) // 100 for a, b in zip(left, right)])
        for more in ({}, {"longest": 300}, {"at_once": 50}, {"alphabet": 2}):
            got = lines.edit_distances(left, right, limit=limit, **more)
            assert [g if g <= n else None for g, n in zip(got, limit)] == [w if w <= n else None for w, n in zip(want, limit)]


def test_band_members_of_large_keys(spark, monkeypatch):
    """Against keys held whole, with large keys that pass as they come and with ids that come twice."""
    np, s = lines.np, lines.Settings(bands=5)
    rng = np.random.default_rng(1)
    low = rng.integers(0, 1 << 16, (60, s.rows * lines.CHOICE)).astype(np.uint16)
    low[10:40] = low[10]  # one large set of classes in every band
    low[45, :] = low[44, :]
    rows = [(i, 7, low[i].tobytes()) for i in range(60)]
    rows += rows[5:20] + [(99, 7, None)]
    table_ = spark.createDataFrame(rows, "id long, chars int, low binary").repartition(3)
    keys = lines.band_keys(low, s)
    want = {frozenset(np.flatnonzero(keys[:, b] == k).tolist()) for b in range(s.bands) for k in keys[:, b]}
    want = {w for w in want if len(w) > 1}
    for most in (1 << 16, 1):
        monkeypatch.setattr(lines, "HELD", most)
        found = {}
        for r in lines.band_members(table_, s).collect():
            found.setdefault(r.key, []).append(r.id)
        assert all(len(ids) == len(set(ids)) for ids in found.values())
        assert {frozenset(ids) for ids in found.values() if len(ids) > 1} == want
        assert len(found) == 2 if most > 1 else len(found) >= 2


def test_first_pairs_of_a_key_meet_the_cheap_condition(spark, tmp_path):
    """Pairs that cannot link are not handed on, and a link that only another pair of the key has is kept."""
    from pyspark.sql import functions as F
    from marketsig.llm import linking
    path = str(tmp_path / "members")
    spark.createDataFrame([(1, 1, 10), (1, 2, 100), (1, 3, 90), (1, 4, 11), (2, 5, 10), (2, 6, 50)],
                          "key long, id long, chars int").write.parquet(path)
    tried = []

    def verify(pairs):
        tried.extend(sorted(tuple(r) for r in pairs.collect()))
        return pairs

    def near(x, y):
        n, m = F.col(f"{x}chars"), F.col(f"{y}chars")
        return 100 * F.least(n, m) >= 80 * F.greatest(n, m)

    got = linking.groups(spark.read.parquet(path), verify, near).collect()
    assert tried == [(1, 4), (2, 3)]
    assert {(r.id, r.component) for r in got} == {(1, 1), (4, 1), (2, 2), (3, 2)}


def test_stored_tables_and_shuffles_go_when_they_are_used(spark):
    import glob
    import time
    from marketsig.llm import common
    from marketsig.session import checkpoint_root
    root = checkpoint_root(spark).replace("file:", "", 1)
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def tables():
        return set(os.listdir(f"{root}/marketsig")) if os.path.isdir(f"{root}/marketsig") else set()

    def shuffles():
        return {x for f in folders for x in glob.glob(f"{f}/*/shuffle_*")}

    before = tables()
    with common.scratch():
        with common.scratch():
            outer = common.stored(spark.range(100), "outer", outlives=1)
            common.stored(spark.range(100), "inner")
            assert len(tables() - before) == 2
        assert len(tables() - before) == 1 and outer.count() == 100
        last = common.stored(outer, "last", outlives=1)
    assert len(tables() - before) == 1 and last.count() == 100
    rows = [(i, f"the very same line of words for all\nanother line {w} of words that is near") for i, w in enumerate(("alpha", "alpho", "gamma"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = tables()
    out = lines.line_groups(docs, lines.EDITS)
    assert {x.rsplit("-", 3)[0] for x in tables() - before} == {"distinct-lines", "grouped-lines", "keepers"}
    assert out.count() == 6
    before = tables()
    left = lines.dedup(docs, lines.EDITS)
    assert {x.rsplit("-", 3)[0] for x in tables() - before} == {"cut-lines"} and left.count() == 1
    before = shuffles()
    common.stored(spark.range(1000).repartition(3, "id"), "dealt")
    for _ in range(100):  # they go soon after the write
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before


def test_band_members_leave_out_unlike_lengths_and_alike_members_unlike_hashes(spark, monkeypatch):
    """Of a key, only classes stay that have a partner of like length and enough equal MinHashes; large keys pass whole."""
    np, s = lines.np, lines.Settings(bands=24)
    low = np.arange(8 * s.rows * lines.CHOICE, dtype=np.uint16).reshape(8, -1) + 1
    chosen = [r * lines.CHOICE for r in range(s.rows)]  # the MinHashes of the first band
    low[:, chosen] = low[0, chosen]
    low[1, [1, 2, 3]] = low[0, [1, 2, 3]]  # seven equal ones
    low[5, [1, 2, 3]] = low[4, [1, 2, 3]]
    chars = [100, 90, 95, 105, 10, 11, 50, 300]
    table_ = spark.createDataFrame([(i, chars[i], low[i].tobytes()) for i in range(8)], "id long, chars int, low binary").repartition(2)
    members = lines.stored(lines.band_members(table_, s), "members")
    found = {}
    for r in members.collect():
        found.setdefault(r.key, []).append((r.id, r.size))
    assert sorted(sorted(v) for v in found.values()) == [[(0, 4), (1, 4), (2, 4), (3, 4)], [(4, 2), (5, 2)]]
    hashes = table_.select("id", "low")

    def alike():
        got = {}
        for r in lines.alike_members(members, hashes, s).collect():
            got.setdefault(r.key, set()).add(r.id)
        return sorted(map(sorted, got.values()))
    assert alike() == [[0, 1], [4, 5]]
    monkeypatch.setattr(lines, "FEW", 3)
    assert alike() == [[0, 1, 2, 3], [4, 5]]


def test_lines_of_travel_alone(spark):
    """Wanted lines come whole, with hardly another one, whatever their bytes."""
    docs = spark.createDataFrame([(i, f"a{i}\n\nb{i} é\n") for i in range(-500, 500)] + [(1000, None)], "doc_id long, text string")
    wanted = spark.createDataFrame([(i, k) for i in range(-500, 500, 100) for k in (0, 2, 3)], "doc_id long, line int")
    got = {(r.doc_id, r.line): r.value for r in lines.lines_of(docs, wanted).collect()}
    assert all(got[i, 0] == f"a{i}" and got[i, 2] == f"b{i} é" and got[i, 3] == "" for i in range(-500, 500, 100))
    assert len(got) <= 60
    assert lines.lines_of(docs, wanted.limit(0)).count() == 0


def test_components_end_at_stars(spark):
    from marketsig.llm import linking
    import random
    rng = random.Random(3)
    for pairs in ([], [(1, 1)], [(1, 2), (1, 3)], [(i, i + 1) for i in range(40)], [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]):
        root = {x: x for p in pairs for x in p}

        def least(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in pairs:
            low, high = sorted((least(a), least(b)))
            root[high] = low
        got = [(r.id, r.component) for r in linking.components(spark.createDataFrame(pairs, "a long, b long")).collect()]
        assert sorted(got) == sorted((x, least(x)) for x in {x for a, b in pairs if a != b for x in (a, b)})
