"""Each operator against its library, SQL or a plain version on small tables, and what it does with odd rows."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import bpe, chat, common, htmltext, mixing, neardup, pq, quality, registry, simhash, suffixdedup, toxicity, warc

FOLDER = os.environ.get("TALLY_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ODD = [(None, None, None, None), (1, "", "en", "s1"), (1, "", "en", "s1"), (2, None, "en", None), (3, "x" * 3000, "fr", "s1"), (4, "a b c " * 800, None, "s2"), (4, "a b c " * 800, None, "s2"), (5, "Ünïcode ☃ text", "de", "s2")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("SCORE", F.lit(1)).withColumn("kept", F.lit("old")).withColumn("epoch", F.lit(9)).withColumn("ids", F.lit(0))


@pytest.fixture(scope="module")
def docs(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def rows_of(rows):
    return sorted(repr(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, docs, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = registry.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert rows_of(df.select(*cols).collect()) == rows_of(con.sql(f"select {quoted} from ({registry.ORACLE[name]})").fetchall())


# BPE

TEXTS = ["", "   ", "İstanbul ΟΔΟΣ", "áé ẛ̣", "<|endoftext|> hi<|startoftext|>x <|endoftext|", "don't I'LL !!'s 'S 123 ４５ ²³", "\x85\x1c a\x00b​ c", "日本語 🎉🎉", "x" * 3000, "ab" * 2000 + "c", "é" * 900, "ſtraſſe ŉ K", "a'l" * 300, "'ll" * 400, "!'s'" * 200]


@pytest.fixture(scope="module")
def tokenizer():
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    return path, Tokenizer.from_file(path)


def test_bpe_equals_the_library(tokenizer, docs):
    path, lib = tokenizer
    random.seed(1)
    odd = TEXTS + ["".join(random.choice(x) for _ in range(2000)) for x in ("abcdeé!?'1 ", "lsvre'dtm", "日本語ab'l é🎉")]
    table = [r["text"] or "" for r in docs.select("text").collect()]
    for leaf, symbols, texts in ((1, 2, odd), (3, 8, odd), (100, 64, odd + table), (bpe.LEAF, bpe.SYMBOLS, odd + table)):
        made = bpe.Bpe(path, leaf, symbols)
        for t in texts:
            want = lib.encode(t, add_special_tokens=False).ids
            assert made.encode(t) == want
            assert made.decode(want) == lib.decode(want, skip_special_tokens=False)
            parts = [(s, made.encode_part(c) if s < 0 else None) for c, s in made.parts(t, 7 if t in odd else 1000)]
            assert np.frombuffer(made.join_parts(parts), "<u4").tolist() == want
    assert made.merge([]) == [] and made.decode([5, 1 << 20]) == lib.decode([5])


def test_the_table_meets_the_joins(tokenizer, docs):
    made = bpe.Bpe(tokenizer[0])
    for r in docs.select("text").collect():
        made.encode(r["text"] or "")
    assert made.joins > 50


def test_long_words_are_halved(tokenizer):
    made = bpe.Bpe(tokenizer[0])
    made.encode("ab" * 2000)
    assert made.token_joins > 20


def test_bpe_over_tables(spark, tokenizer, odd):
    path, lib = tokenizer
    got = bpe.decode(bpe.encode(odd, path, part=100), path, out="decoded").collect()
    assert len(got) == len(ODD)
    want = sorted((r[0] or 0, lib.encode(r[1] or "", add_special_tokens=False).ids) for r in ODD)
    assert sorted((r["doc_id"] or 0, np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == want
    assert bpe.encode(odd.limit(0), path).isEmpty()


# Quality


def plain_measures(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", text or "") if w]
    seen: dict = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, odd):
    random.seed(2)
    rows = [(i, "".join(random.choice(["a", "b", " ", " ", "\n", "#", "\t", "é"]) for _ in range(random.randrange(300))), "en", "s") for i in range(60)] + ODD
    got = quality.measure(spark.createDataFrame(rows, SCHEMA).withColumn("n_words", F.lit("old"))).select(*quality.MEASURES).collect()
    assert sorted(map(tuple, got)) == sorted(plain_measures(r[1]) for r in rows)
    clashing = odd.withColumn("host_ok", F.lit(1)).withColumn("host", F.lit("h")).withColumn("words", F.lit("w")).withColumn("row", F.lit(2))
    out = quality.quality(clashing)
    assert out.count() == len(ODD)
    assert {(r["host_ok"], r["host"], r["words"], r["row"]) for r in out.collect()} == {(1, "h", "w", 2)}
    assert quality.measure(clashing).count() == len(ODD)
    assert quality.quality(odd.limit(0)).isEmpty()


def test_a_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, good if i % 10 else "bad", "en", "good") for i in range(100)] + [(200 + i, "bad" if i % 10 else good, "en", "bad") for i in range(100)]
    got = quality.quality(spark.createDataFrame(rows, SCHEMA)).groupBy("source").agg(F.sum(F.col("kept").cast("int")).alias("n")).collect()
    assert {r["source"]: r["n"] for r in got} == {"good": 90, "bad": 0}


# Mixing


def test_budgets_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 100, 1), ("a", "x", "2", 1000, 1), ("b", "y", "3", 1000, 1)], "domain string, language string, source string, tokens long, rows long")
    got = {r["source"]: r["budget"] for r in mixing.budgets(leaves, 1000.0, {}, 1).collect()}
    assert got == {"1": 100, "2": 400, "3": 500}


def test_mix(spark, odd):
    rows = [(i, "w " * (1 + i % 7), "en", f"s{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    all_twice = mixing.mix(df, share=2.0, max_epochs=2)
    assert all_twice.count() == 600
    half = mixing.mix(df, share=0.5, max_epochs=1)
    total = sum(1 + i % 7 for i in range(300))
    assert abs(half.agg(F.sum("n_tokens")).first()[0] - total / 2) < 3 * 7
    clashing = odd
    for c in ("whole", "edge", "last", "buckets", "left", "row", "t", "n", "salt", "rows", "low", "take"):
        clashing = clashing.withColumn(c, F.lit(c))
    for text in (True, False):
        got = mixing.mix(clashing, share=1.0, keep_text=text)
        assert got.where("doc_id = 1 or doc_id is null").isEmpty() and not got.isEmpty()
        assert {r["left"] for r in got.collect()} == {"left"}
        assert got.columns.count("text") == text
    assert mixing.mix(odd.limit(0)).isEmpty()


def plain_mix(rows, budget):
    """Places taken of one leaf, in the order of md5(mix:0:id)."""
    out, used = [], 0
    for i, t in sorted(rows, key=lambda r: (hashlib.md5(f"mix:0:{r[0]}".encode()).hexdigest(), r[0])):
        if used < budget and t.split():
            out.append(i)
            used += len(t.split())
    return sorted(out)


@pytest.mark.parametrize("ranges", [{}, {"RADIX": 256, "RANGE_ROWS": 2}], ids=["plain", "narrow"])
def test_budgets_end_among_equal_rows(spark, monkeypatch, ranges):
    for k, v in ranges.items():
        monkeypatch.setattr(mixing, k, v)
    equal, thrice = [(7, "a b c d e f g h i j")] * 100, [(i // 3, "w " * (1 + i // 3 % 5)) for i in range(200)]
    for rows, share, text in ((equal, 0.8, True), (thrice, 0.3, False), (thrice, 0.805, True)):
        df = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], SCHEMA).repartition(3)
        budget = round(share * sum(len(t.split()) for _, t in rows))
        got = mixing.mix(df, share=share, max_epochs=1, keep_text=text)
        assert sorted(r["doc_id"] for r in got.collect()) == plain_mix(rows, budget)


# Chat


def test_chat_fold(spark):
    log = [(1, 0, "start", 1, "user", "hi"), (1, 1, "start", 2, "assistant", ""), (1, 2, "delta", 2, None, "He"), (1, 3, "start", 3, "user", "<\\turn>\n</turn>"), (1, 5, "regenerate", 2, None, None), (1, 6, "delta", 2, None, "Yo\\0"), (1, 7, "edit", 1, None, "HI"), (1, 8, "start", 4, "a>\nb", "z<"), (2, 1, "start", 1, None, None)]
    out = chat.formatted(spark.createDataFrame(log, "conv_id long, seq long, kind string, message_id long, role string, text string"))
    got = {r["conv_id"]: r for r in out.select("conv_id", chat.parse(F.col("formatted")).alias("t"), chat.masked(F.col("formatted"), F.col("mask")).alias("m")).collect()}
    assert [tuple(t) for t in got[1]["t"]] == [("user", "HI"), ("assistant", "Yo\\0"), ("a>\nb", "z<")]
    assert got[1]["m"] == ["Yo\\0"]
    assert [tuple(t) for t in got[2]["t"]] == [("", "")]
    with pytest.raises(Exception, match="unknown event kind"):
        chat.fold(spark.createDataFrame([(1, 1, "x", 1, "r", "t")], "conv_id long, seq long, kind string, message_id long, role string, text string")).collect()


def test_chat_log_folds_to_its_messages(spark):
    rows = [(c, m, r, t) for c in (1, 2) for m, (r, t) in enumerate([("user", "ab<c"), ("assistant", ""), ("user", "x"), ("assistant", "é☃ two"), ("assistant", "\\### Assistant: </turn> ok"), ("", "long " * 5000)], 1)]
    df = spark.createDataFrame(rows, "conv_id long, message_id long, role string, text string").withColumn("seq", F.lit("clash"))
    log = chat.log_of(df).withColumn("n", F.lit(0))
    assert {r["kind"] for r in log.collect()} == {"start", "delta", "edit", "regenerate"}
    got = chat.fold(log).orderBy("conv_id", "at").collect()
    assert [(r["conv_id"], r["role"], r["text"]) for r in got] == [(c, r, t) for c, _, r, t in rows]
    assert chat.formatted(log.limit(0)).isEmpty()


def test_a_large_conversation(spark):
    df = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), (F.col("id") + 1).alias("message_id"), F.lit("assistant").alias("role"), F.repeat(F.lit("ab <"), 50).alias("text"))
    r = chat.formatted(chat.log_of(df)).select(F.size(chat.parse(F.col("formatted"))).alias("n"), F.length(F.concat_ws("", chat.masked(F.col("formatted"), F.col("mask")))).alias("m")).first()
    assert (r["n"], r["m"]) == (3000, 3000 * 200)


# Toxicity


def test_toxicity_learns_and_keeps_out(spark, odd):
    random.seed(3)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        t = [word() for _ in range(30)]
        if bad:
            t[random.randrange(30)] = "vilified" + random.choice("xyz")
        rows.append((i, " ".join(t), ("en", "fr")[i % 2], "s"))
        labels.append((i, int(bad)))
    df, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(df, toxicity.fit(df, lab)).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 3 == 0) for r in held]) > 0.95
    none = toxicity.score(odd, toxicity.fit(df, lab.limit(0)))
    assert none.count() == len(ODD)
    assert none.where("score is null or score < 0 or score > 1").isEmpty()


def test_held_out_labels(spark, docs):
    folder = FOLDER.replace("sf0.001", "sf0.1")
    if not os.path.isdir(folder):
        pytest.skip("no larger table here")
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = spark.read.parquet(f"{folder}/documents.parquet").join(labels.select("doc_id"), "doc_id").select("doc_id", "lang", "text")
    got = toxicity.score(known.where(toxicity.held_out(F.col("doc_id"))), toxicity.fit(known, labels))
    rows = got.join(labels, "doc_id").select("toxic", "score").collect()
    good, bad = ([r["score"] for r in rows if r["toxic"] == k] for k in (0, 1))
    assert len(good) > 200 and len(bad) > 10
    auc = np.mean([(b > g) + (b == g) / 2 for b in bad for g in good])
    hits = sum(x >= 0.5 for x in bad)
    f1 = 2 * hits / (hits + sum(x >= 0.5 for x in good) + len(bad))
    assert auc > 0.9 and f1 > 0.75


def test_toxicity_of_odd_tables(spark, odd):
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, toxic int")
    model = toxicity.fit(odd.limit(0), labels)
    assert toxicity.score(odd.limit(0), model).isEmpty()
    repeated = spark.createDataFrame([(i, f"{w} " * 30, "en", "s") for i in range(40) for w in ("alpha", "beta")], SCHEMA)
    every = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    a, b = (toxicity.fit(x, every) for x in (repeated, repeated.orderBy(F.desc("text")).repartition(3)))
    assert np.array_equal(a.table, b.table) and a.shift == b.shift
    few = toxicity.fit(repeated, every, class_bytes=1)  # one row of each class
    assert few.score("alpha") == few.score("other words")


def test_pooling_in_chunks():
    rng = np.random.default_rng(1)
    m = toxicity.Cnn(rng.normal(size=(toxicity.TABLE, toxicity.DIM)).astype("f4"), [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)).astype("f4") for w in toxicity.WIDTHS], np.zeros(3 * toxicity.FILTERS, "f4"), np.ones(3 * toxicity.FILTERS, "f4"), 0.0)
    t = " ".join(f"w{i % 77}x{i % 13}" for i in range(1000))
    assert np.array_equal(m.pooled(t), m.pooled(t, chunk=64))


# WARC


def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://x/{i}\r\n", "<p>" + "abc é" * (i % 7 * 10)) for i in range(60)] + [(None, None, None), (5, "u", "dup"), (5, "u", "dup"), (70, None, "x" * 500), (71, None, "x" * 500), (None, "n", "x" * 500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("other"))
    warc.write(df, str(tmp_path / "a"), frames=5)
    got = warc.read_archives(spark, str(tmp_path / "a")).collect()
    want, first = [], {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, p), p)
    for p, _, h in rows:
        raw = (h or "").encode()
        ref = first.get(h) if p is not None and p > first.get(h, p) else None
        want.append((-1 if p is None else p, "response" if ref is None else "revisit", -1 if ref is None else ref, len(raw), hashlib.sha256(raw).hexdigest()))
    got_ids = sorted((-1 if r["page_id"] is None else r["page_id"], r["record_type"], -1 if r["refers_to"] is None else r["refers_to"], r["header_bytes"], r["header_digest"]) for r in got)
    assert got_ids == sorted(want)
    back = sorted((-1 if r["page_id"] is None else r["page_id"], r["record_type"], -1 if r["refers_to"] is None else r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.resolved(warc.read_archives(spark, str(tmp_path / "a"))).collect())
    assert back == sorted(want)
    assert all(r["payload"] is None or hashlib.sha256(r["payload"]).hexdigest() == r["header_digest"] for r in got)
    warc.write(df.limit(0), str(tmp_path / "b"))
    assert warc.read_archives(spark, str(tmp_path / "b")).isEmpty()


def test_warc_archives_end_by_bytes(spark, tmp_path):
    noise = np.random.default_rng(3)
    rows = [(i, "u", noise.bytes(30_000).hex()) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write(df, str(tmp_path / "a"), most=1 << 20)
    sizes = [f.stat().st_size for f in (tmp_path / "a").glob("part-*")]
    assert len(sizes) > 1 and max(sizes) < 6 << 20
    got = warc.read_archives(spark, str(tmp_path / "a")).select("page_id", "payload").collect()
    assert sorted((r["page_id"], bytes(r["payload"]).decode()) for r in got) == [(i, h) for i, _, h in rows]


# HTML


@pytest.mark.parametrize(("page", "text"), [
    ("", ""), (None, ""), ("just text &amp; more", "just text & more"),
    ("<div>a <b>x</b>y<br>c &lt; d</div><p>q<p>r<ul><li>1<li>2</ul><script>x</p>", "a xy\nc < d\nq\nr\n1\n2"),
    ("<body><nav><a>m</a></nav><div class=sidebar>no</div><section><p>one long text here<p>two text</section><section><p>three more words</section><div class='comments'><p>c</div><footer>f</footer></body>", "one long text here\ntwo text\nthree more words"),
    ("<body><header>top</header><article><header><h1>T</h1></header><form>x</form><p>a\n  b</p><aside>z</aside></article></body>", "T\na b"),
    ("<body><article>x <!-- c --> y<style>p{}</style><script>var a='<p>'</script></article>", "x y"),
])
def test_main_text(page, text):
    assert htmltext.main_text(page) == text


@pytest.mark.parametrize(("page", "text"), [
    ('<body><div class="layout-sidebar-right"><article><p>one long text here</article><div class="sidebar">no</div></div></body>', "one long text here"),
    ('<body><div id="content-with-sidebar"><main><p>one long text here</main></div><div class="site-footer">f</div></body>', "one long text here"),
    ('<body><div class="sidebar"><div class="page_nav_wrap"><article>a b</article></div></div></body>', "a b"),
    ('<body><div class="content-sidebar"><p>one long text here, longer than the rest<p>and more</div><div class="page-footer">f</div></body>', "one long text here, longer than the rest\nand more"),
    ("<body><article>short</article><div class='post-comments'><p>a much longer comment than the article is</div></body>", "short"),
    ("<body><article>text of it</article><div class='sidebar'><article>card</article></div></body>", "text of it"),
    ("<body><section><p>short text</section><div class='comments'><article class=comment>a much longer comment</article></div></body>", "short text"),
    ("<body><section><p>the text itself</section><div class=sidebar>longer than the text is, by far</div></body>", "the text itself"),
])
def test_main_text_in_layouts(page, text):
    assert htmltext.main_text(page) == text


@pytest.mark.parametrize(("page", "text"), [
    ("<body><article><p>This is the text of it, long</p><p class='notice-period'>three months</p><div class='related'>and this</div></article></body>", "This is the text of it, long\nthree months\nand this"),
    ("<body><article id=social-security><p>some text here</p><p>more</p></article></body> after it, longer", "some text here\nmore\nafter it, longer"),
    ("<body><div><h1>Title</h1><div><p>one long text here</p><p>and another one here</p></div></div><div class=ad>buy</div></body>", "Title\none long text here\nand another one here"),
    ("<p title=it's>it's 1 < 2</p>", "it's 1 < 2"), ("a < b <c", "a < b <c"), ("<p x='>'>y</p><p x=\">z", "y\nz"),
])
def test_main_text_drops_nothing_else(page, text):
    assert htmltext.main_text(page) == text


@pytest.mark.parametrize("unit", ["<a ", "<div><p>", "<a \">", "<a x=\">", "<a x=\">\"", "<!-- ", "<header>", "<table><tr><td>", "<li>"])
def test_hostile_pages_take_linear_time(unit):
    import time

    at = time.process_time()
    htmltext.main_text(unit * (1_000_000 // len(unit)))
    assert time.process_time() - at < 10


def plain_densities(root):
    """By node in page order: composite density and density sum, from the formula, by recursion over nested lists (tag, *children)."""
    def text(x, linked=False, inside=False):
        """Characters, or only those in links."""
        if isinstance(x, str):
            return len("".join(x.split())) if inside or not linked else 0
        return sum(text(c, linked, inside or x[0] == "a") for c in x[1:])

    def tags(x, only=False, inside=False):
        return 0 if isinstance(x, str) else sum((not isinstance(c, str) and (not only or inside or c[0] == "a")) + tags(c, only, inside or (not isinstance(c, str) and c[0] == "a")) for c in x[1:])

    import math

    share = text(root, True) / text(root)
    out = []

    def visit(x, inside):
        inside = inside or x[0] == "a"
        c, t, lt = text(x), max(tags(x), 1), max(tags(x, True, inside), 1)
        lc = c if inside else text(x, True)
        d = c / t * math.log(c / max(lc, 1) * t / lt) / math.log(math.log(c / max(c - lc, 1) * lc + share * c + math.e)) if c else 0.0
        k = len(out)
        out.append([d, 0.0])
        for child in x[1:]:
            if not isinstance(child, str):
                out[k][1] += visit(child, inside)
        return d

    visit(root, False)
    return out


def test_densities_equal_the_formula():
    r = random.Random(8)

    def grow(depth):
        return [r.choice(["div", "section", "b", "a"]), *[grow(depth - 1) if depth and r.random() < 0.6 else "".join(r.choice("ab c") for _ in range(r.randrange(1, 40))) for _ in range(r.randrange(1, 5))]]

    def shown(x):
        return x if isinstance(x, str) else f"<{x[0]}>" + "".join(map(shown, x[1:])) + f"</{x[0]}>"

    def text_in(x, link):
        return bool(x.strip()) and link if isinstance(x, str) else any(text_in(c, link or x[0] == "a") for c in x[1:])

    seen = 0
    while seen < 40:
        tree = ["body", *[grow(3) for _ in range(3)]]
        if not text_in(tree, False):
            continue
        seen += 1
        density, total = htmltext.Page(shown(tree)).densities()
        want = plain_densities(tree)
        assert len(density) == len(want) + 1
        assert np.allclose(density[1:], [d for d, _ in want]) and np.allclose(total[1:], [t for _, t in want])


def test_main_text_keeps_rows(spark):
    df = spark.createDataFrame([(1, "<p>a", "old", 3), (1, "<p>a", "old", 3), (None, None, None, 3)], "page_id long, html string, text string, row int")
    got = htmltext.extract(df).collect()
    assert sorted(r["text"] for r in got) == ["", "a", "a"] and {r["row"] for r in got} == {3}
    assert htmltext.extract(df.limit(0)).isEmpty()


# Near copies


def test_simhash_links(spark):
    random.seed(4)
    base = [random.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for _ in range(12):
            fps.add(b ^ sum(1 << i for i in random.sample(range(64), random.randrange(1, 6))))
    fps = sorted(fps)
    want = {tuple(sorted((int(np.uint64(a).astype(np.int64)), int(np.uint64(b).astype(np.int64))))) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3}
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    for hot in (64, 1):
        assert {(r["a"], r["b"]) for r in simhash.links(df, hot_bucket=hot).collect()} == want


def plain_simhash(text):
    import xxhash

    w = re.findall("[^\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(len(w) - 2, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(docs):
    texts = ["", None, "A b", "Ünï É x", "a\u00a0b c\x1cd e", "x " * 500, "one Two\x0bthree"] + [r["text"] for r in docs.select("text").limit(60).collect()]
    assert [simhash.simhash64(t) for t in texts] == [plain_simhash(t) for t in texts]


def test_a_chain_of_fingerprints(spark):
    """200 fingerprints, ids ascending along the chain; each three bits from the next."""
    r = random.Random(12)
    chain = [r.getrandbits(64)]
    for _ in range(199):
        chain.append(chain[-1] ^ sum(1 << b for b in r.sample(range(64), 3)))
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in chain], "fp long")
    got = common.components(simhash.links(df)).collect()
    assert len(got) == 200 and len({x["root"] for x in got}) == 1


def test_a_chain_of_vectors(spark):
    """200 unit vectors, each at a cosine of 0.9808 to the next, that turn from axis to axis."""
    rows = []
    for k in range(200):
        v = np.zeros(32)
        axis, step = divmod(k, 8)
        v[axis], v[axis + 1] = np.cos(step * np.pi / 16), np.sin(step * np.pi / 16)
        rows.append((k, v.tolist(), 1))
    got = pq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r["component_id"] for r in got} == {0}
    assert sorted(r["n_links"] for r in got) == [1, 1] + [2] * 198


def test_simhash_groups(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: (r["fp"], r["component_id"]) for r in got}
    assert by[None] == by[1] == by[2] == (0, 1)
    assert by[4][1] == 4
    assert simhash.one_of_each(odd).count() == 5  # 1, 3, 4, 5 and the row without an id
    assert simhash.near_duplicates(odd.limit(0)).isEmpty()


def plain_groups(texts, similarity=0.8, words=5):
    """A root for each text, by all pairs."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(len(w) - words, 0) + 1)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if (both * 10 >= similarity * 10 * (len(x) + len(sets[j]) - both)) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def planted_copies():
    """Texts with copies of one to eight words changed in 150, a chain of copies, many copies of one text, and short texts."""
    r = random.Random(11)
    word = lambda: f"w{r.randrange(5000)}"

    def copy(w, changes):
        w = list(w)
        for i in r.sample(range(len(w)), changes):
            w[i] = word()
        return w

    made = []
    for k in range(60):
        base = [word() for _ in range(150)]
        made += [base, copy(base, 1 + k % 8), copy(base, 3)]
    chain = [word() for _ in range(150)]
    for _ in range(12):
        made.append(chain := copy(chain, 2))
    base = [word() for _ in range(200)]
    made += [copy(base, 1 + k % 4) for k in range(90)]
    texts = [" ".join(w) for w in made] + ["a b c", "A b\tc", "a b", "", None]
    return r.sample(texts, len(texts))


def test_near_copies_equal_brute_force(spark):
    texts = planted_copies()
    want = plain_groups(texts)
    assert 60 < len(set(want)) < len(texts) - 90
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.one_of_each(df).collect()) == sorted(set(want))
    assert simhash.one_of_each(df.limit(0)).isEmpty()


def test_buckets_are_laid_out_once(spark):
    r = random.Random(12)
    rows = [(c, [-7] * (c % 2) + [c % 900, 10_000 + c] + r.sample(range(20_000, 10**6), 3)) for c in range(-6000, 6000)] + [(10**6, [])]
    buckets = {}
    for c, keys in rows:
        for k in keys:
            buckets.setdefault(k, []).append(c)
    want = sorted((k, c, min(cs)) for k, cs in buckets.items() if len(cs) > 1 for c in cs)
    df = spark.createDataFrame(rows, "c long, keys array<long>")
    got = neardup._met(df)
    assert len(buckets[-7]) == 6000 and sorted(tuple(x) for x in got.collect()) == want
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Generate ") == 1 and "Join" not in plan
    assert neardup._met(df.limit(0)).isEmpty()


def test_near_copies_under_one_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(100)) for x in "ab")
    rows = [(1, a, "s1"), (1, b, "s1"), (1, b, "s1"), (2, b + " more", "s1"), (3, a, "s2"), (4, "c d", "s2"), (4, "c d", "s1"), (None, a, "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [[tuple(r) for r in simhash.one_of_each(x).collect()] for x in (df, df.repartition(3).orderBy(F.desc("text"), "source"))]
    assert rows_of(got[0]) == rows_of(got[1])
    assert {r[:2] for r in got[0]} == {(1, a), (1, b), (4, "c d"), (None, a)} and len(got[0]) == 4


@pytest.mark.parametrize("edges", [
    [],
    [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 200)] + [(300, 300)],
    [(i, i + 1) for i in range(10_000)] + [(20_000, 20_001 + i) for i in range(10_000)],
], ids=["none", "small", "long chain and hub"])
def test_components(spark, edges):
    rounds = []
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long"), rounds).collect()}
    assert len(rounds) <= 14
    linked = {x for a, b in edges if a != b for x in (a, b)}
    hub = max((a for a, b in edges if a != b and a >= 100), default=0) if len(edges) < 1000 else 20_000
    assert got.keys() == linked and all(got[x] == x for x in got.values())
    assert len({(x >= hub, r) for x, r in got.items()}) == len(set(got.values())) == (2 if edges else 0)


# Repeats


def plain_removals(rows, length=50):
    first: dict = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1 if i is not None else 0):
            k = b[p : p + length]
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1 if i is not None else 0):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1])), kept))
    return sorted(map(repr, out))


def test_suffix_classes():
    random.seed(9)
    for _ in range(60):
        unit = bytes(random.choice(b"ab") for _ in range(random.randrange(3, 80)))
        t = b"".join(random.choice([unit, unit[2:], b"a", b"b"]) for _ in range(30)) + b"a" * 50
        starts = np.array(sorted(random.sample(range(len(t) - 49), (len(t) - 49) // 2)))
        found = suffixdedup.suffix_classes(np.frombuffer(t, np.uint8), starts)
        names = {t[s : s + 50]: int(k) for s, k in zip(starts, found, strict=True)}
        assert [names[t[s : s + 50]] for s in starts] == found.tolist() and len(set(names.values())) == len(names)
        assert sorted(names) == sorted(names, key=names.get)  # the order of the suffixes


@pytest.mark.parametrize("sizes", [
    {}, {"block_bytes": 3000, "part_bytes": 5000, "segment": 256}, {"block_bytes": 1000, "part_bytes": 500, "segment": 256, "coarse_parts": 3}, {"length": 47}, {"length": 101, "block_bytes": 500},
], ids=["plain", "small", "dealt twice", "short", "long"])
def test_suffix_dedup(spark, sizes):
    random.seed(5)
    base = ["".join(random.choice("ab cdé\n") for _ in range(random.choice([30, 60, 120, 400]))) for _ in range(20)]
    rows = [(i, "".join(random.choice(base)[random.randrange(20) :] for _ in range(random.randrange(6)))) for i in range(80)]
    rows += [(5, "x" * 300), (7, "x" * 500), (7, "x" * 500), (None, "x" * 300), (8, None), (9, ""), (-3, "y" * 49), (-2, "y" * 50), (-1, "y" * 51), (200, base[0] * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("KEPT", F.lit(1)).withColumn("b", F.lit(2)).withColumn("rest", F.lit(3)).repartition(3)
    got = suffixdedup.removals(df, **sizes).collect()
    assert sorted(repr((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))) for r in got) == plain_removals(rows, sizes.get("length", 50))
    assert {(r["b"], r["rest"]) for r in got} == {(2, 3)}


def test_suffix_dedup_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffixdedup.removals(df).isEmpty()


def test_suffix_dedup_as_text(spark):
    df = spark.createDataFrame([(1, "é" * 60), (2, "x" + "é" * 60 + "y")], "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in suffixdedup.removals(df, as_text=True).collect()}
    assert got == {1: "é" * 60, 2: "xy"}


# Embeddings


@pytest.mark.parametrize("small", [{}, {"PER_LIST": 40, "MEMBERS": 8, "VISITORS": 30, "AGAIN": 60, "RARE": 2}], ids=["plain", "dealt anew"])
def test_embeddings(spark, monkeypatch, small):
    for k, v in small.items():
        monkeypatch.setattr(pq, k, v)
    rng = np.random.default_rng(6)
    rows = []
    for c in range(30):
        centre = rng.normal(size=16)
        for _ in range(12):
            rows.append((len(rows), [float(x) for x in (centre + rng.normal(size=16) * 0.12).astype("f4")], c % 3))
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(5)] + [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (2003, rows[0][1], None), (2004, [1.0], 0), (2005, [], 0), (2006, [None] * 16, 0), (2007, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pq.near_duplicates(df).collect()}
    good = [r for r in rows if r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    parent = {r[0]: r[0] for r in rows}
    n = dict.fromkeys(parent, 0)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(good):
        for b in good[i + 1 :]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], "f8"), np.array(b[1], "f8")
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                    n[a[0]] += 1
                    n[b[0]] += 1
                    p, q = root(a[0]), root(b[0])
                    parent[max(p, q)] = min(p, q)
    assert sum(n.values()) > 50
    assert got == {k: (n[k], root(k), root(k) == k) for k in parent}
    assert pq.near_duplicates(df.limit(0)).isEmpty()


# Pipeline


def test_pipeline_stage_by_stage(spark, docs, tokenizer):
    import corpus_pipeline as p

    path, lib = tokenizer
    made, before = docs, docs
    for name, stage in p.STAGES[:-1]:
        before = made
        made = common.cut(stage(spark, before, FOLDER))
        assert made.columns == p.COLUMNS, name
        assert made.count() <= before.count()
        texts = {r["doc_id"]: r["text"] for r in before.select("doc_id", "text").collect()}
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{FOLDER}/labels.parquet"))
            langs = {r["doc_id"]: r["lang"] for r in before.select("doc_id", "lang").collect()}
            want = {i for i, t in texts.items() if model.score(t) < model.thresholds.get(langs[i], 0.5)}
            assert {r["doc_id"] for r in made.select("doc_id").collect()} == want
        if name == "simhash_near_dedup":
            ids = sorted(texts)
            assert {r["doc_id"] for r in made.select("doc_id").collect()} == {ids[k] for k in plain_groups([texts[i] for i in ids])}
        if name == "mixing":
            words = {i: len((t or "").split()) for i, t in texts.items()}
            leaf = {r["doc_id"]: (r["source"], r["lang"]) for r in before.select("doc_id", "source", "lang").collect()}
            taken = {r["doc_id"] for r in made.select("doc_id").collect()}
            place = lambda i: (hashlib.md5(f"mix:0:{i}".encode()).hexdigest(), i)
            for one in set(leaf.values()):  # a prefix of the seeded order
                order = sorted((i for i, x in leaf.items() if x == one and words[i]), key=place)
                n = len(taken.intersection(order))
                assert set(order[:n]) == taken.intersection(order)
            share = sum(words[i] for i in taken) / sum(words.values())
            assert 0.79 < share < 1  # each leaf may go over by less than a document
        if name == "suffix_array_dedup":
            want = {eval(x, {"__builtins__": {}})[0]: eval(x, {"__builtins__": {}})[4].decode("utf-8", "ignore") for x in plain_removals([tuple(r) for r in before.select("doc_id", "text").collect()])}
            assert {r["doc_id"]: r["text"] for r in made.select("doc_id", "text").collect()} == want
    out = p.STAGES[-1][1](spark, made, FOLDER).collect()
    texts = {r["doc_id"]: r["text"] for r in made.collect()}
    assert len(out) == len(texts) > 0
    for r in out:
        assert np.frombuffer(r["ids"], "<u4").tolist() == lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids


def test_pipeline_of_odd_tables(spark, tokenizer):
    import corpus_pipeline as p

    extra = ["row", "score", "kept", "epoch", "text_", "ids", "h", "c", "root", "id"]
    rows = [(i, t, lang, source, None) for i, t, lang, source in [*ODD, (6, "a b c d e f " * 20 + "z" * 60, "en", "s1"), (7, "a b c d e f " * 20 + "z" * 60, "en", "s9")]]
    for docs in (spark.createDataFrame(rows, SCHEMA + ", n_chars long"), spark.createDataFrame([], SCHEMA + ", n_chars long")):
        n = docs.count()
        for c in extra:
            docs = docs.withColumn(c, F.lit("x"))
        for _, stage in p.STAGES[:-1]:
            docs = common.cut(stage(spark, docs, FOLDER))
            assert docs.columns == p.COLUMNS
        out = p.STAGES[-1][1](spark, docs, FOLDER)
        assert (out.count() > 0) == (n > 0)
