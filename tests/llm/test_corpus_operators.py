"""Corpus operators against brute force, round trips and held-out accuracy, on small and awkward tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sentrylake.llm import bpe, huffman, langid, line_rules, prefix_tree, sharding, tiling, tokens, toxicity, warc, wrappers
from sentrylake.llm.common import pick
from sentrylake.session import materialize, scratch_path

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = [f"w{i}" for i in range(400)]


def some_text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Null ids and texts, empty and long texts, repeated rows, near copies, and columns whose names clash."""
    rng = random.Random(5)
    base = some_text(rng, 120)
    near = base.split()
    near[60] = "other"
    rows = [
        (1, base), (2, " ".join(near)), (3, base), (3, base), (4, None), (5, ""), (6, " \n\t "), (None, base), (None, "nobody knows"), (7, "Nobody  knows"),
        (8, "two words"), (9, some_text(rng, 30_000)), (10, "a" * 20_000), (11, "漢字 é x's\n\n  y"), (12, base.upper()), (12, some_text(rng, 40)),
    ]
    return spark.createDataFrame([(i, t, "x", "src", 0) for i, t in rows], "doc_id long, text string, DOC_ID string, source string, n int"), rows


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


# ---- 1


def test_warc_round_trip_and_revisits(spark):
    pages = [(1, "http://a.b/x", "<p>é</p>"), (2, "http://a.b/y", "<p>é</p>"), (3, None, None), (4, "bad\r\nurl", ""), (None, "http://c/", "<p>é</p>"), (None, "u", "alone"), (5, "http://a.b/x", "x" * 100_000)]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, PAGE_ID string")
    manifest = materialize(warc.write_packages(warc.with_revisits(df), scratch_path(spark, "t"), package_bytes=300), "m")
    got = warc.read_packages(manifest, range_bytes=200).withColumn("page_id", warc.id_of("record_id")).withColumn("to", warc.id_of("refers_to")).collect()
    want = Counter()
    for i, _, page in pages:
        payload = (page or "").encode()
        best = max((p[0] for p in pages if (p[2] or "").encode() == payload and p[0] is not None), default=None)
        to = best if best != i else None
        want[i, "response" if to is None else "revisit", to, len(payload), warc.payload_digest(payload)] += 1
    assert Counter((r.page_id, r.record_type, r.to, r.payload_bytes, r.digest) for r in got) == want
    assert {r.page_id: bytes(r.payload) for r in got if r.page_id == 5}[5] == b"x" * 100_000
    assert warc.read_packages(manifest.limit(0)).count() == 0


def test_zip64_directory_and_index(tmp_path):
    import pyarrow.fs as fs

    writer = warc._PackageWriter(f"file://{tmp_path}", "2000-01-01T00:00:00Z", True)
    for i in range(5):
        writer.add(i, f"http://h/{i}", b"p%d" % i, None)
    path, n, _ = writer.close()
    assert n == 5
    with fs.LocalFileSystem().open_input_file(path.removeprefix("file://")) as f:
        assert {m.name for m in warc.members(f, f.size())} == {warc.ARCHIVE, warc.INDEX, warc.PACKAGE}
    assert sum(size for _, _, _, size in warc.ranges(path, 1)) == sum(size for _, _, _, size in warc.ranges(path))


# ---- 2


def brute_measures(text):
    import re

    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    covered = {p for starts in at.values() if len(starts) > 1 for i in starts for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_line_rules(spark, awkward, empty):
    df, rows = awkward
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in line_rules.judge(df).collect())
    assert got == Counter((i, *brute_measures(t)) for i, t in rows)
    assert line_rules.judge(empty).count() == 0
    loops = spark.createDataFrame([(1, "a b c d e f g h " * 30), (2, "x|y #z\nx|y #z\n\n q"), (3, " ".join(WORDS[:10] + WORDS[:10]))], "doc_id long, text string").selectExpr("*", "cast(null as string) as source")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in line_rules.judge(loops).collect()}
    assert got == {r.doc_id: brute_measures(r.text) for r in loops.collect()}


def test_frequent_lines_are_removed(spark):
    shared = " ".join(WORDS[:60])
    own = [" ".join(WORDS[100 + 7 * i : 125 + 7 * i]) for i in range(15)]
    rows = [(i, f"{shared.upper()}\n{own[i]}", "h") for i in range(15)] + [(100, f"{shared}\n{some_text(random.Random(1), 90)}", "h"), (200, shared, "other")]
    got = {r.doc_id: r for r in line_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), with_text=True).collect()}
    assert not any(got[i].kept for i in range(15)) and got[0].text == own[0] and got[0].n_removed_words == 60
    assert got[100].kept and got[200].kept and got[200].n_removed_words == 0


# ---- 3


def test_shards_are_near_equal_and_gapless(spark, awkward, empty):
    df, rows = awkward
    records = pick(df, doc_id="doc_id", text="text").select("doc_id", sharding.size_of(F.col("text")).alias("size"))
    got = sharding.shard_by_bytes(records, 3, range_bytes=1000).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").encode()) + 8) for i, t in rows)
    hot = spark.range(6000).selectExpr("if(id < 4000, 7, id) as doc_id", "100 + id % 50 as size", "1 as shardless")
    placed = sharding.shard_by_bytes(hot, 24, range_bytes=4000).toPandas()
    sums = placed.groupby("shard")["size"].sum()
    assert len(sums) == 24 and sums.max() - sums.min() <= 2 * 150
    for _, g in placed.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    ordered = placed.sort_values(["shard", "slot"])["doc_id"].tolist()
    assert ordered == sorted(ordered)
    assert sharding.shard_by_bytes(empty.selectExpr("doc_id", "1 as size"), 4).count() == 0


# ---- 4


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    low = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    return Counter((r[0], len(s), low[g]) for r, s, g in zip(rows, sets, group, strict=True))


def test_components_equal_brute_force(spark, awkward, empty):
    df, rows = awkward
    got = prefix_tree.alike_documents(df, counters=64, filter_bits=64, block=2).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    assert prefix_tree.alike_documents(empty).count() == 0


@pytest.mark.parametrize(("seed", "many", "dealt"), [(1, 32, 1024), (2, 2, 3)])
def test_chains_of_near_copies(spark, monkeypatch, seed, many, dealt):
    monkeypatch.setattr(prefix_tree, "ROUNDS", seed % 2)
    rng, rows = random.Random(seed), []
    for family in range(6):
        words = [f"f{family}_{rng.randrange(60)}" for _ in range(rng.choice([6, 30, 80]))]
        for _ in range(12):
            words = [w if rng.random() > 0.03 else f"n{rng.randrange(99)}" for w in words]
            rows.append((len(rows), " ".join(words[: len(words) - rng.randrange(3)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = materialize(prefix_tree.alike_documents(df, counters=256, filter_bits=256, block=3, many=many, dealt=dealt), "t")
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == brute_components(rows)
    kept = prefix_tree.one_of_each(df, found)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute_components(rows)})


def test_one_of_each_keeps_what_is_alone(spark, awkward):
    df, _ = awkward
    kept = prefix_tree.one_of_each(df, materialize(prefix_tree.alike_documents(df), "t"))
    assert kept.columns == df.columns
    assert sorted((r[0] is None, r[0] or 0) for r in kept.collect()) == [(False, i) for i in (1, 4, 5, 6, 7, 8, 9, 10, 11, 12)]


@given(st.lists(st.frozensets(st.integers(0, 30), min_size=1, max_size=12), min_size=1, max_size=12), st.frozensets(st.integers(0, 30), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_tree_search_equals_brute_force(sets, probe):
    tree = prefix_tree.Tree(np.zeros(0, np.uint64))
    for i, s in enumerate(sets):
        tree.add(np.array(sorted(s), np.uint64), i)
    got = tree.search(np.array(sorted(probe), np.uint64))
    assert sorted(got) == [i for i, s in enumerate(sets) if 100 * len(s & probe) >= 75 * len(s | probe)]


@given(st.frozensets(st.integers(0, 400), min_size=1, max_size=300), st.frozensets(st.integers(0, 400), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_signatures_differ_no_more_than_sets(left, right):
    sigs = [prefix_tree.signature(prefix_tree.mix(np.array(sorted(s), np.uint64))).tobytes() for s in (left, right)]
    assert prefix_tree.bits_apart(*sigs) == prefix_tree.bits_apart(*sigs[::-1]) <= len(left ^ right)


# ---- 5


@given(st.lists(st.integers(1, 10**9), min_size=1, max_size=300), st.integers(9, 14))
@settings(max_examples=40, deadline=None)
def test_lengths_are_a_prefix_code_and_decode(counts, limit):
    lengths = huffman.code_lengths(np.array(counts), limit)
    assert lengths.max() <= limit and sum(2.0 ** -int(x) for x in lengths) <= 1
    code = huffman.Code(np.arange(len(counts)) * 3, lengths)
    ids = np.random.default_rng(1).integers(0, len(counts), 700) * 3
    data, used, own = code.pack(ids, np.array([300, 0, 400]))
    first = np.array([own[0], own[300] + used[0] * 8])
    assert (code.unpack(np.frombuffer(data + bytes(4), np.uint8), first, np.array([300, 400])) == ids).all()


def test_huffman_files(spark, awkward, empty):
    from tokenizers import Tokenizer

    df, rows = awkward
    plain = Tokenizer.from_file(JSON)
    for docs, want in ((df, rows), (empty, [])):
        ids = materialize(tokens.token_table(docs, JSON), "ids")
        counts = {(r.id, r.n) for r in tokens.counted(ids).collect()}
        ids = tokens.documents(ids)
        assert counts == {(r.id, r.n) for r in huffman.count_ids(ids).collect()}
        code = huffman.code_of(huffman.count_ids(ids))
        manifest = materialize(huffman.write_files(ids, code, scratch_path(spark, "t"), file_bytes=2000), "m")
        got = sorted((r.start, r.doc_id, list(r.ids)) for r in huffman.read_files(manifest).collect())
        encoded = Counter((i, tuple([*plain.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in want)
        assert Counter((i, tuple(x)) for _, i, x in got) == encoded
        assert [s for s, _, _ in got] == [0, *np.cumsum([len(x) for _, _, x in got]).tolist()][: len(got)]
        named = [-1 if i is None else i for _, i, _ in got]
        assert named == sorted(named)
        digests = Counter((r.doc_id, r.ids_crc32) for r in huffman.read_files(manifest, digest=True).collect())
        assert digests == Counter((i, zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in encoded.elements())


@given(st.lists(st.text(alphabet="ab1 \n\t é漢'!s", max_size=40), max_size=8))
@settings(max_examples=80, deadline=None)
def test_pieces_encode_as_the_whole(texts):
    encode = tokens.encoder(JSON)
    want = [np.array(encode.tokenizer.encode(t, add_special_tokens=False).ids, encode.dtype).tobytes() for t in texts]
    assert encode.encode(texts) == want


@given(st.lists(st.lists(st.sampled_from(["word", "Ab", "é", "ſ", "ҁ", "7", "½", "ª", ".", ",", "'s", "<|endoftext|>", "|", "\n", "\n\n", "\t", " ", " ", "×", "漢", "\x7f"]), max_size=25).map("".join), max_size=6))
@settings(max_examples=80, deadline=None)
def test_pre_tokens_encode_as_the_whole(texts):
    for special_as_text in (True, False):
        encode = tokens.encoder(JSON, special_as_text)
        want = [np.array(encode.tokenizer.encode(t, add_special_tokens=False).ids, encode.dtype).tobytes() for t in texts]
        assert encode._plain == special_as_text and encode.encode(texts) == want


def test_pieces_go_to_the_model_once_and_common_ones_are_kept(monkeypatch):
    """New words don't go through the whole tokenizer, and a worker that forgets keeps the words it still meets."""
    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    encode = tokens.PieceEncoder(JSON)
    asked, of_model = [], encode._of_model
    monkeypatch.setattr(encode, "_of_model", lambda x: asked.append(x) or of_model(x))
    monkeypatch.setattr(encode, "_ids_after_space", lambda x: [] if not x else pytest.fail(f"through the whole tokenizer: {x}"))
    for k in range(10):
        text = "the " + " ".join(f"common w{chr(97 + k)}{chr(97 + i)}rd." for i in range(15))
        assert encode.encode([text]) == [np.array(encode.tokenizer.encode(text, add_special_tokens=False).ids, encode.dtype).tobytes()]
    assert asked.count(" common") == 1 and asked.count(" wbbrd") == 1 and asked.count(".") <= 2
    assert len(encode._after_space) + len(encode._before) <= 80


def test_words_of_several_pieces_go_to_the_model_once(monkeypatch):
    """A word before different signs is one pre-token, and each piece is one look-up, however often texts have it."""
    encode = tokens.PieceEncoder(JSON)
    asked, of_model = [], encode._of_model
    monkeypatch.setattr(encode, "_of_model", lambda x: asked.append(x) or of_model(x))
    texts = ["a zorbel. zorbel, zorbel! zorbel? zorbel\nzorbel zorbel zorbel.", None, "", " zorbel", "zorbel", "zorbel  x", "x don't <zorbel zorbel"]
    want = [np.array(encode.tokenizer.encode(t or "", add_special_tokens=False).ids, encode.dtype) for t in texts]
    ids, ends = encode.encode_array(pa.array(texts))
    assert ends.tolist() == np.cumsum([len(x) for x in want]).tolist() and (ids == np.concatenate(want)).all()
    assert asked.count(" zorbel") == 1 and asked.count("zorbel") == 1
    assert encode.encode(texts[::-1]) == [x.tobytes() for x in want[::-1]] and asked.count(" zorbel") == 1


def test_runs_of_other_characters_have_no_ids_of_their_own():
    """A sign that stood alone before is no pre-token where letters follow."""
    encode = tokens.PieceEncoder(JSON)
    for texts in (["a 漢 ' ½ | ĳ"], ["a 漢word 'tis ½7 |x 漢.\n漢 word漢"], ["b word漢 漢 漢word"]):
        assert encode.encode(texts) == [np.array(encode.tokenizer.encode(t, add_special_tokens=False).ids, encode.dtype).tobytes() for t in texts]


def test_texts_are_split_some_at_a_time(monkeypatch):
    monkeypatch.setattr(tokens, "AT_ONCE", 10)
    texts = ["four", None, "five5", "", "é" * 20, "x", "y" * 10, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["doc_id", "text"])
    parts = [x.column(1).to_pylist() for x in tokens._parts_of(batch)]
    assert parts == [["four", None, "five5", ""], ["é" * 20], ["x"], ["y" * 10, None]]
    assert list(tokens._parts_of(batch.slice(0, 0))) == []


def test_blocks_of_all_sizes_decode_side_by_side():
    rng = np.random.default_rng(5)
    sizes = np.array([1, 0, 512, 3, 77, 512, 0, 1, 300])
    ids = (rng.zipf(1.2, int(sizes.sum())) % 5000).astype(np.uint32)
    code = huffman.Code.from_counts(*np.unique(ids, return_counts=True))
    data, used, own = code.pack(ids, sizes)
    some = sizes > 0
    first = (np.cumsum(used) - used)[some] * 8
    assert (own[(np.cumsum(sizes) - sizes)[some]] == 0).all() and len(data) == used.sum()
    assert (code.unpack(np.frombuffer(data + bytes(4), np.uint8), first, sizes[some]) == ids).all()
    assert len(code.unpack(np.zeros(4, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_an_id_without_a_code_is_refused():
    code = huffman.Code.from_counts(np.array([3, 9]), np.array([5, 1]))
    for ids in ([3, 4], [3, 10]):
        with pytest.raises(ValueError, match="no code"):
            code.pack(np.array(ids, np.uint32), np.array([2]))
    assert code.pack(np.zeros(0, np.uint32), np.array([0]))[0] == b""


# ---- 6


def page(article, n, menu="m"):
    return (
        f"<html><head><title>t{n}</title><script>var a='<p>no</p>'</script></head><body><nav><a href=x>{menu}{n}</a></nav><div class='site-notice'>note {n}</div>"
        f"{article}<div class=comments><p>I agree {n}</p></div><form><p>mail {n}</p></form><footer>f{n}</footer>"
    )


def test_main_text(spark):
    rows = [(i, f"http://h.example/{i}", page(f"<article><h1>T{i}</h1><p>Share this<p>One &amp; <b>t</b>wo {i}<br>x<p>more  {i}</article>", i)) for i in range(10)]
    plain = [(100 + i, f"http://p.example/{i}", f"<div id=top>The same head</div><div><p>text {i}<p>and &eacute; {i * i}</div><div>The same foot") for i in range(10)]
    odd = [(200, None, None), (201, "", ""), (202, "u", "no tags &lt; here"), (None, "http://h.example/z", "<p>unclosed <b>bold")]
    df = spark.createDataFrame([(*r, 1) for r in rows + plain + odd], "page_id long, url string, html string, HOST int")
    got = {r.page_id: r.text for r in wrappers.extract(df).collect()}
    assert got[3] == "T3 Share this One & two 3 x more 3"
    assert got[104] == "text 4 and é 16"
    assert (got[200], got[201], got[202], got[None]) == ("", "", "no tags < here", "unclosed bold")
    assert wrappers.extract(df.limit(0)).count() == 0


def test_region_of_a_host_without_tags_or_names():
    rng, pages = random.Random(14), []
    for i in range(12):
        body = "".join(f"<p>{some_text(rng, rng.randrange(3, 40))}.</p>" for _ in range(rng.randrange(1, 5)))
        menu = "".join(f"<li><a href=/{k}>{some_text(rng, 1)}</a></li>" for k in range(6))
        head = f"<h1>{some_text(rng, 3)}</h1>"
        kin = "".join(f"<li><a href=/r{k}>{some_text(rng, 2)}</a></li>" for k in range(rng.randrange(2, 5)))
        pages.append((f"<div><ul>{menu}</ul></div><div class=x7>{some_text(rng, 4)}</div><div class=q>{head}<div>{body}<div>Send to a friend</div><div class=k><ul>{kin}</ul></div></div></div><div>&copy; {some_text(rng, 5)}</div>", head + body))
    wrapper = None
    for page, _ in pages:
        tree = wrappers.fold(wrappers.parse(page))
        wrapper = wrappers.bounded(wrappers.merged(wrapper, tree) if wrapper else tree)
    for page, article in pages:
        assert wrappers.main_text(page, wrapper) == " ".join(article.replace("<p>", " ").replace("</p>", " ").replace("<h1>", "").replace("</h1>", " ").split())


@pytest.mark.parametrize("page, text", [
    ("<body class='single no-sidebar'><article><p>One</article>", "One"),
    ("<div id='search-results'><article><p>One</article></div>", "One"),
    ("<div class='content has-sidebar'><p>One</div>", "One"),
    ("<article><p>One<h2 id='related-work'>Related work</h2><p>Two</article>", "One Related work Two"),
    ("<article><p>One</p><section id='notice-period'><p>Two</section></article>", "One Two"),
    ("<article><p>One</p><figure class='image-share'>Two</figure></article>", "One Two"),
    ("<article><p>One</p><div class='ad-box'>no</div><div class=comments><p>no</div></article>", "One"),
    ("<div>" * 5000 + "One" + "</div>" * 5000 + "<p>Two", "One Two"),
])
def test_names_and_depth_lose_no_text(page, text):
    assert wrappers.main_text(page, None) == text


def test_long_lists_of_children_are_cut():
    one, two = (wrappers.fold(wrappers.parse("".join(f"<div class=c{i + k}>x</div>" for i in range(20_000)))) for k in (0, 7))
    assert len(wrappers.merged(one, two)[3]) == 20_007 and wrappers.matching(one, two) == 1 + 20_000 - 7
    one, two = (wrappers.fold(wrappers.parse("".join(f"<div class=c{i * k % 501}>x</div>" for i in range(5000)))) for k in (1, 7))
    pairs = wrappers.aligned(one[3], two[3])
    assert [x for x, _ in pairs if x] == one[3] and [y for _, y in pairs if y] == two[3] and all(x[0] == y[0] for x, y in pairs if x and y)


@given(st.recursive(st.just([]), lambda kids: st.lists(st.tuples(st.sampled_from("ab"), kids), max_size=3), max_leaves=6), st.recursive(st.just([]), lambda kids: st.lists(st.tuples(st.sampled_from("ab"), kids), max_size=3), max_leaves=6))
@settings(max_examples=60, deadline=None)
def test_matching_is_the_largest(one, two):
    node = lambda label, kids: [label, 1, 0, [node(*x) for x in kids], 0, 0]

    def largest(a: list, b: list) -> int:
        """Over all ways to match children in order."""
        if not a or not b:
            return 0
        both = 1 + largest(a[0][1], b[0][1]) + largest(a[1:], b[1:]) if a[0][0] == b[0][0] else 0
        return max(both, largest(a[1:], b), largest(a, b[1:]))

    assert wrappers.matching(node("r", one), node("r", two)) == 1 + largest(one, two)


def test_matching_keeps_order():
    a = wrappers.fold(wrappers.parse("<div><p>a<ul><li>x</ul><p>b</div>"))
    b = wrappers.fold(wrappers.parse("<div><ul><li>x<li>y</ul><p>c</div>"))
    assert wrappers.matching(a, a) == 6 and wrappers.matching(a, b) == 5
    both = wrappers.merged(a, b)
    assert both[1] == 2 and [x[0] for x in both[3][0][3]] == ["p", "ul", "p"]


# ---- 7 and 10


def test_toxicity_finds_rare_forms(spark, empty):
    rng, rows = random.Random(2), []
    for i in range(400):
        text = some_text(rng, 60).split()
        if i % 5 == 0:
            text[rng.randrange(60)] = "vequ" + rng.choice(["a", "mo", "re", "ta", "lis", "x"]) + " scoundrel"
        rows.append((" ".join(text), int(i % 5 == 0)))
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    rng = random.Random(3)
    tests = [(some_text(rng, 200), 0) for _ in range(40)] + [(some_text(rng, 150) + " vequtali scoundrel " + some_text(rng, 40), 1) for _ in range(40)] + [(None, 0), ("", 0), ("!!! 123", 0)]
    got = spark.createDataFrame(tests, "text string, toxic int").select("toxic", toxicity.score(model).alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in got) and np.mean([(r.s >= toxicity.REJECT) == r.toxic for r in got]) > 0.95
    blank = toxicity.fit(empty.selectExpr("text", "1 as toxic"))
    assert spark.createDataFrame([("a",), (None,)], "text string").select(toxicity.score(blank).alias("s")).count() == 2


def test_copies_of_one_toxic_text_are_learned_and_drawn_once(spark, monkeypatch):
    rng = random.Random(21)
    ordinary = [(some_text(rng, 60), 0) for _ in range(300)] + [(some_text(rng, 50) + " vequtali scoundrel", 1) for _ in range(80)]
    words = ["zub" + x + "qim" for x in "abcdefghijklmnop"]  # each only in copies of one text
    copied = [(f"{some_text(rng, 30)} {w} {w} {w} {some_text(rng, 30)}", 1) for w in words for _ in range(20)]
    fitted = []
    monkeypatch.setattr(toxicity, "_fit_scale", lambda v, y, *more, real=toxicity._fit_scale: fitted.append(len(y)) or real(v, y, *more))
    df = spark.createDataFrame(ordinary + copied, "text string, toxic int")
    model = toxicity.fit(df)
    for w in words:  # its 5-grams are known, whichever texts fit the scale
        g = toxicity._text_grams(w)[4:]
        assert not np.isnan(toxicity.look_up(model.ratios, 0, g, toxicity.ORDER)).any()
    assert 0 < fitted[0] <= 396 / 4
    hot = spark.createDataFrame([(t, y) for t, y in ordinary for _ in range(30)], "text string, toxic int")
    toxicity.fit(hot)
    assert 0 < fitted[1] <= 380 / 4
    alike = spark.createDataFrame([(f"kalo {w}", "aa") for w in words[:4] for _ in range(500)], "text string, lang string")
    seen = []
    monkeypatch.setattr(langid, "materialize", lambda df, name, real=langid.materialize: seen.append(real(df, name)) or seen[-1])
    langid.fit(alike, centroids=2, sample=20)
    assert seen[0].count() == 4


def test_words_are_held_against_texts_as_long(spark, monkeypatch):
    rng = random.Random(31)
    sizes = [1, 3, 20, 60, 200, 900]
    rows = [(some_text(rng, rng.choice(sizes)), 0) for _ in range(500)]
    rows += [(f"{some_text(rng, n := rng.choice(sizes))} vequ{rng.choice(['mo', 'ta', 'lis'])} scoundrel {some_text(rng, n)}", 1) for _ in range(120)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    tests = [(some_text(rng, 60_000), 0) for _ in range(4)] + [(some_text(rng, n), 0) for n in (1, 2, 5) for _ in range(5)]
    tests += [(f"{some_text(rng, 400)} vequta scoundrel {some_text(rng, 400)}", 1), ("vequmo", 1), ("scoundrel", 1), ("vequta scoundrel", 1)]
    got = spark.createDataFrame(tests, "text string, toxic int").select("toxic", toxicity.score(model).alias("s")).collect()
    assert all((r.s >= toxicity.REJECT) == bool(r.toxic) for r in got), got
    monkeypatch.setattr(toxicity, "look_up", lambda table, which, keys, level: np.full(len(keys), 2.0))  # every letter has 2: so has every text, however short
    assert [toxicity.evidence(t, None, None) for t in ("a", "vequmo", "x " * 500, "y" * 16, "")] == [(4.0, 2.0, 1), (14.0, 2.0, 1), (4.0, 2.0, 500), (17.0, 2.0, 2), (0.0, 0.0, 1)]


def test_tables_grow_in_shards_and_check_their_keys(spark, monkeypatch):
    rng = np.random.default_rng(8)
    keys = np.unique(rng.integers(0, 1 << 40, 5000))
    rows = [(int(4 + k % 2), int(k), float(i), float(-i) if i % 3 else None, 1, int(i % 3 > 0)) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "level int, key long, ratio double, ratio_less double, n long, n_less long")
    monkeypatch.setattr(toxicity, "SHARD", 700)
    table = toxicity._table(df)
    assert len(table.shards) == 8 and all(table.shards)
    for level in (4, 5):
        own = keys % 2 == level - 4
        at = np.flatnonzero(own)
        assert (toxicity.look_up(table, 0, keys[own], level) == at).all() and np.isnan(toxicity.look_up(table, 0, keys[~own], level)).all()
        less = toxicity.look_up(table, 1, keys[own], level)
        assert (np.isnan(less) == (at % 3 == 0)).all() and (less[at % 3 > 0] == -at[at % 3 > 0]).all()
    assert np.isnan(toxicity.look_up(toxicity._table(df.limit(0)), 0, keys, 4)).all()


@pytest.mark.parametrize("far", [8.0, 20.0, 200.0])
def test_scale_is_the_minimum_however_far_the_toxic_are(far):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(2, 1, 800), rng.normal(4.5, 0.5, 40), rng.normal(far, 1, 50)])
    labels = np.repeat([0, 1], [800, 90])
    slope, more, middle = toxicity._fit_scale(values, labels, rng.normal(-1, 0.1, 890))
    assert 0.5 < slope < 10 and more >= 0 and 2.5 < middle < 4.5


def test_ratios_are_those_of_kneser_ney_by_definition(spark):
    rng = random.Random(12)
    rows = [(some_text(rng, 4), i % 2) for i in range(30)] + [("ab ab", 1)]
    df = spark.createDataFrame([(t, y, False) for t, y in rows], "text string, toxic int, aside boolean")
    found = {(r.level, r.key): r.ratio for r in toxicity.log_ratios(toxicity.counts(df))[0].collect()}
    top = {y: Counter(int(g) for t, label in rows if label == y for g in toxicity._text_grams(t)) for y in (0, 1)}
    order, bits, d = toxicity.ORDER, toxicity.BITS, toxicity.DISCOUNT
    seen = {(order, y): dict(top[y]) for y in (0, 1)} | {(order, 2): dict.fromkeys(top[0] | top[1], 1)}
    for k in range(order - 1, 0, -1):  # different letters ahead of an n-gram, of a class and of both
        for y in (0, 1, 2):
            seen[k, y] = Counter(g & ((1 << bits * k) - 1) for g in seen[k + 1, y])

    def chance(g: int, k: int, y: int) -> float:
        of = seen[k, y if k > toxicity.SHARED else 2]
        if k == 1:
            return of[g] / sum(of.values())
        below = chance(g & ((1 << bits * (k - 1)) - 1), k - 1, y)
        siblings = [n for x, n in of.items() if x >> bits == g >> bits]
        if not siblings:
            return below
        return (max(0.0, of.get(g, 0) - d) + d * len(siblings) * below) / sum(siblings)

    assert {k for k in found} == {(k, g) for k in range(toxicity.SHARED + 1, order + 1) for g in seen[k, 2]}
    for (k, g), ratio in list(found.items())[::7]:
        assert abs(ratio - np.log(chance(g, k, 1) / chance(g, k, 0))) < 1e-6


def test_evidence_is_the_same_in_slices(monkeypatch):
    from sentrylake.llm import letters

    monkeypatch.setattr(toxicity, "look_up", lambda table, which, keys, level: np.where(keys % 3 == 0, np.nan, np.sin(keys % 1009)))
    tables = None, None
    texts = [some_text(random.Random(5), 300), "ab" + "1" * 300 + "cde" + "!" * 200 + "fghijk", "abc" + " " * 500, ""]
    whole = [toxicity.evidence(t, *tables) for t in texts]
    monkeypatch.setattr(letters, "SLICE", 97)
    assert np.allclose([toxicity.evidence(t, *tables) for t in texts], whole)


def test_long_texts_are_scored_whole(monkeypatch):
    from sentrylake.llm import letters

    text = some_text(random.Random(4), 300)
    whole = [np.concatenate([letters.grams(s, 5) for s in letters.streams(text, 4, 4)]), langid.counts(text)]
    monkeypatch.setattr(letters, "SLICE", 97)
    cut = [np.concatenate([letters.grams(s, 5) for s in letters.streams(text, 4, 4)]), langid.counts(text)]
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))


def test_language(spark, empty):
    sounds = {"aa": ["ka", "lo", "mi"], "bb": ["str", "ung", "ich"], "cc": ["é", "oux", "tion"]}
    rng = random.Random(6)
    made = lambda lang, n: " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(n))
    known = spark.createDataFrame([(made(x, 40), x) for x in sounds for _ in range(30)] + [(None, "aa"), ("12", "bb"), ("x", None)], "text string, lang string")
    model = langid.fit(known, centroids=2, sample=20)
    tests = [(made(x, 15), x) for x in sounds for _ in range(20)]
    got = spark.createDataFrame([*tests, (None, "und"), ("", "und"), ("123 !", "und"), ("漢字漢字", "far")], "text string, lang string").select("lang", langid.predict(model).alias("p")).collect()
    assert np.mean([r.p.lang_pred == r.lang for r in got if len(r.lang) == 2]) > 0.95
    assert all(r.p.rejected and r.p.score == 0 for r in got if r.lang == "und") and all(r.p.rejected for r in got if r.lang == "far")
    nothing = langid.fit(empty.select("text", "lang"))
    assert spark.createDataFrame([("abc",)], "text string").select(langid.predict(nothing)["lang_pred"]).first()[0] == "und"


def test_clusters_take_little_more_than_the_vectors():
    """No task has all components of its vectors at hand; the centroids are those of whole vectors."""
    import tracemalloc

    rng = np.random.default_rng(3)
    vectors = np.zeros((600, langid.SIZE))
    for i, v in enumerate(vectors):
        v[rng.choice(2000, 300, replace=False) + 1500 * (i % 3)] = rng.random(300)
    vectors /= np.sqrt((vectors * vectors).sum(1))[:, None]
    rows = [(np.flatnonzero(v).astype(np.uint16), v[np.flatnonzero(v)]) for v in vectors]
    tracemalloc.start()
    got = langid.cluster(rows, 3, 4)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < vectors.nbytes / 20
    chosen = [vectors[int(np.argmax(vectors @ vectors.sum(0)))]]
    while len(chosen) < 3:
        chosen.append(vectors[int(np.argmin(np.max(vectors @ np.stack(chosen).T, 1)))])
    want = np.stack(chosen)
    for _ in range(4):
        own = np.argmax(vectors @ want.T, 1)
        sums = [vectors[own == j].sum(0) if (own == j).any() else want[j] for j in range(3)]
        want = np.stack([x / np.sqrt(float(x @ x)) for x in sums])
    assert np.allclose(got, want, atol=1e-7)


def test_only_sparse_vectors_get_to_a_cluster(spark):
    rows = [("b a", "x"), ("Zebra zoo", "x"), ("77", "x"), ("ça va", "y"), ("a" * 5000, "y")]
    idf = np.linspace(1, 2, langid.SIZE).astype(np.float32)
    found = langid.sparse_vectors(spark.createDataFrame(rows, "text string, lang string"), idf).collect()
    assert sorted((r.lang, r.nth) for r in found) == [("x", 2), ("x", 3), ("y", 1), ("y", 2)]
    texts = {("x", 2): "Zebra zoo", ("x", 3): "b a", ("y", 1): "a" * 5000, ("y", 2): "ça va"}
    for r in found:
        v = np.zeros(langid.SIZE)
        v[np.frombuffer(r.at, np.uint16)] = np.frombuffer(r.value)
        assert (v == langid.vector(texts[r.lang, r.nth], idf)).all()


def test_unlearned_languages_of_the_same_script_are_rejected(spark):
    sounds = {"aa": ["ka", "lo", "mi", "ne", "tu"], "bb": ["str", "ung", "ich", "tu", "ge"], "zz": ["prz", "ka", "ych", "owa", "zky", "dwi"]}
    rng = random.Random(16)
    made = lambda lang, n: " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(n))
    noise = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(n))
    known = [(made(x, rng.choice([3, 20, 60, 200])), x) for x in ("aa", "bb") for _ in range(100)]
    model = langid.fit(spark.createDataFrame(known, "text string, lang string"), centroids=4)
    finnish = "Suomen kieli on itämerensuomalainen kieli jota puhutaan pääasiassa Suomessa mutta myös muissa maissa joissa on suomalaisia"
    far = [made("zz", 60) for _ in range(10)] + [noise(80) for _ in range(10)] + [finnish]
    near = [made(x, n) for x in ("aa", "bb") for n in (1, 2, 5, 30, 400) for _ in range(10)] + ["Kalomi " * 300]
    rows = [(t, "far") for t in far] + [(t, "near") for t in near]
    got = spark.createDataFrame(rows, "text string, kind string").select("kind", langid.predict(model).alias("p")).collect()
    assert all(r.p.rejected for r in got if r.kind == "far") and not any(r.p.rejected for r in got if r.kind == "near")


# ---- 8


def test_byte_bpe_of_chunks(spark, awkward, empty):
    df, rows = awkward
    rng = random.Random(3)
    odd = [(1000 + i, "".join(rng.choice(["a", "  ", "\n", "\n\n", "'s", "'re", "é", "1", "!!", " ", "漢", "\t", "'"]) for _ in range(rng.choice([5, 300, 1500])))) for i in range(30)]
    docs = pick(df, doc_id="doc_id", text="text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    back = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN, chunk=100, overlap=30), RANKS, public_tokenizers.PATTERN)
    whole = bpe.codec(RANKS, public_tokenizers.PATTERN)[0]
    want = Counter((i, np.array(whole.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows + odd)
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.bytes)) for r in back.collect()) == want
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


# ---- 9


def brute_tiles(left, right, least):
    marked_a, marked_b, total = set(), set(), 0
    while True:
        best = (least - 1, None)
        for i in range(len(left)):
            for j in range(len(right)):
                n = 0
                while i + n < len(left) and j + n < len(right) and left[i + n] == right[j + n] and i + n not in marked_a and j + n not in marked_b:
                    n += 1
                if n > best[0]:
                    best = (n, (i, j))
        if best[1] is None:
            return total
        n, (i, j) = best
        marked_a |= set(range(i, i + n))
        marked_b |= set(range(j, j + n))
        total += n


@given(st.lists(st.sampled_from("abc"), max_size=30), st.lists(st.sampled_from("abc"), max_size=20), st.integers(2, 4))
@settings(max_examples=60, deadline=None)
def test_tiles_equal_brute_force(left, right, least):
    tiles = tiling.greedy_tiles(left, right, least)
    assert all(left[i : i + n] == right[j : j + n] and n >= least for i, j, n in tiles)
    assert sorted((n for _, _, n in tiles), reverse=True) == [n for _, _, n in tiles]
    assert sum(n for _, _, n in tiles) == brute_tiles(left, right, least)


def test_reordered_passages_are_caught(spark, empty):
    rng = random.Random(8)
    items = [some_text(rng, 40) for _ in range(4)] + ["only three words", None, ""]
    parts = items[0].split()
    docs = [
        (1, some_text(rng, 50) + " " + items[1].upper() + " " + some_text(rng, 9)), (2, " ".join([*parts[20:], "and", *parts[:20]])), (3, some_text(rng, 300)),
        (4, " ".join(parts[:15])), (5, "Here are Only  three words again"), (6, None), (7, ""), (None, items[2]), (1, "another text"),
    ]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, ITEM_ID string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = materialize(tiling.contaminated(df, bench, filter_bits=1 << 12), "t")
    assert sorted((str(r.doc_id), r.item_id, r.n_covered) for r in found.collect()) == [("1", 1, 40), ("2", 0, 40), ("5", 4, 3), ("None", 2, 40)]
    left = tiling.without_contaminated(df, found)
    assert left.columns == df.columns and Counter(r[0] for r in left.collect()) == Counter([1, 3, 4, 6, 7])
    assert tiling.contaminated(empty, bench).count() == 0 and tiling.contaminated(df, bench.limit(0)).count() == 0


def test_repetitive_items_equal_brute_force(spark):
    rng = random.Random(18)
    refrain = (["oh", "la", "li"] * 14)[:40]
    items = [refrain, ["1"] * 30, *([rng.choice("abc") for _ in range(rng.choice([8, 20, 35]))] for _ in range(8)), some_text(rng, 30).split()]
    docs = [["so", *refrain, "end"], ["2", *["1"] * 30], refrain[:19], ["1"] * 5, *([rng.choice("abc") for _ in range(60)] for _ in range(8)), items[-1][10:] + items[-1][:10]]
    frame = lambda rows, name: spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], f"{name} long, text string")
    found = tiling.contaminated(frame(docs, "doc_id"), frame(items, "item_id"), filter_bits=1 << 12).collect()
    want = {(i, j): brute_tiles(d, w, 5) for i, d in enumerate(docs) for j, w in enumerate(items)}
    assert {(r.doc_id, r.item_id): r.n_covered for r in found} == {k: n for k, n in want.items() if n >= 0.5 * len(items[k[1]])}
    assert want[0, 0] == 40 and want[1, 1] == 30


# ---- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(docs.columns)
    texts = {r.doc_id: r.text for r in corpus_pipeline.table(spark, folder, "documents").collect()}
    rows = docs.collect()
    assert 0 < len(rows) <= len(texts) and len({r.doc_id for r in rows}) == len(rows)
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)


def test_trees_of_pairs_join_a_group_of_near_copies():
    """Of a block of sets alike a seed takes fewer pairs than sets; they reach all of them, other seeds take other pairs."""
    common = prefix_tree.mix(np.arange(60, dtype=np.uint64))
    sets = [np.sort(np.append(common, prefix_tree.mix(np.array([1000 + i], np.uint64)))) for i in range(40)]
    n = len(sets)
    block = (
        int(common.min()), list(range(n)), np.full(n, 61), np.zeros(n, np.int64), np.arange(n), np.zeros(n, int),
        [prefix_tree.signature(x).tobytes() for x in sets], sets, False, 75,
    )
    every = prefix_tree._pairs_of_block(*block)
    assert len(every) == n * (n - 1) // 2
    trees = [prefix_tree._pairs_of_block(*block, seed) for seed in (0, 1)]
    for tree in trees:
        assert len(tree) == n - 1 and set(tree) <= set(every)
        reached = {0}
        for _ in range(n):
            reached |= {x for pair in tree if reached & set(pair) for x in pair}
        assert len(reached) == n
    assert set(trees[0]) != set(trees[1])


@pytest.mark.parametrize("dealt", [3, 8, 1000])
def test_frequent_ngrams_are_sent_once_for_each_block_of_others(spark, dealt):
    """Every two sets of two components meet once; a large component's sets aren't sent for each of its own blocks, for trees once."""
    rows = [(7, i, (9 << 32) + i, 0 if i < 60 else i, 65) for i in range(65)] + [(8, i, 9 << 32, i, 4) for i in range(4)]
    df = spark.createDataFrame(rows, "token long, sid long, meta long, root long, many long")
    groups = {}
    sent = prefix_tree._dealt(df, dealt).collect()
    for r in sent:
        groups.setdefault((r.token, r.i, r.j), []).append(r)
    met = Counter()
    for (token, i, j), own in groups.items():
        for a in own:
            for b in own:
                if a.sid < b.sid and a.root != b.root and (i == j or a.part != b.part):
                    met[token, a.sid, b.sid] += 1
    want = {(t, a, b) for t, n in ((7, 65), (8, 4)) for a in range(n) for b in range(a + 1, n) if t == 8 or b >= 60}
    assert set(met) == want and set(met.values()) == {1}
    main, others = (0, 1) if dealt >= 65 else (-(-60 // dealt), -(-5 // dealt))
    assert sum(r.token == 7 for r in sent) == (65 if dealt >= 65 else 60 * others + 5 * (main + others))
    alone = [prefix_tree._alone(df, dealt, seed).collect() for seed in (1, 2)]
    assert all(sorted((r.token, r.sid) for r in x) == sorted((r[0], r[1]) for r in rows) and all(r.i == r.j for r in x) for x in alone)
    assert ({(r.token, r.sid, r.i) for r in alone[0]} == {(r.token, r.sid, r.i) for r in alone[1]}) == (dealt >= 65)
