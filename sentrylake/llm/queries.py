"""Registered queries of the corpus operators, one for each, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.llm import bpe, huffman, langid, line_rules, merkle, mixing, negatives, prefix_tree, sharding, tiling, tokens, toxicity, warc, wrappers
from sentrylake.llm.common import pick, table
from sentrylake.session import materialize, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op5_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written as Huffman-coded files and read back from them."""
    ids = materialize(tokens.token_table(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0), "ids")
    code = huffman.code_of(tokens.counted(ids))
    manifest = materialize(huffman.write_files(tokens.documents(ids), code, scratch_path(spark, "tidh")), "tidh-manifest")
    return huffman.read_files(manifest, digest=True)


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the bytes that they decode to, as digests."""
    import public_tokenizers

    path, pattern = vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    back = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return back.select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@query
def op1_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record in ZIP packages, read back by ranges."""
    rows = warc.with_revisits(table(spark, sf_dir, "pages"), min_bytes=0)
    manifest = materialize(warc.write_packages(rows, scratch_path(spark, "wacz")), "wacz-manifest")
    return warc.read_packages(manifest).select(
        warc.id_of("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
        "record_type", warc.id_of("refers_to").alias("refers_to"),
    )


ORACLES["op1_warc_packages"] = """
with p as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages
), f as (select hex, max(page_id) as first_id from p group by hex),
j as (select p.*, case when f.first_id is distinct from p.page_id then f.first_id end as refers_to from p join f using (hex))
select page_id, octet_length(encode(html))::bigint as payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, (5 * (i // 4) + 1)::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31), 1)), 'string_agg', '') as payload_digest,
  case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to
from j
"""


@query
def op3_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes, in order of their ids."""
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    records = docs.select(
        "doc_id", sharding.size_of(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = sharding.shard_by_bytes(records, 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op7_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of the held-out third aren't used."""
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    scored = docs.select("doc_id", toxicity.held_out(F.col("doc_id"), 3, 1).alias("held_out"), toxicity.score(model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= toxicity.REJECT, 1).otherwise(0))


@query
def op10_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; a held-out quarter teaches nothing."""
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text", lang="lang")
    out = toxicity.held_out(F.col("doc_id"), 4, 2)
    model = langid.fit(docs.where(~out).select("text", "lang"))
    found = docs.select("doc_id", out.alias("held_out"), langid.predict(model).alias("x"))
    return found.select("doc_id", "held_out", "x.lang_pred", "x.score", "x.rejected")


@query
def op9_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that tiles of them cover, with the tiles."""
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of five words are alike by three quarters or more."""
    found = prefix_tree.alike_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


ORACLES["op4_prefix_tree_join"] = """
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words from documents
), s as (
  select doc_id, case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
    else list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) end as set from w
), g as (select doc_id, len(set) as n, unnest(set) as gram from s),
h as (select * from g where gram in (select gram from g group by gram having count(*) > 1)),
links as (
  select a.doc_id as a, b.doc_id as b from h a join h b on a.gram = b.gram and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach(a, b) as (select doc_id, doc_id from s union select r.a, l.b from reach r join links l on l.a = r.b)
select s.doc_id, len(s.set)::bigint as n_shingles, r.low as component_id
from s join (select a, min(b) as low from reach group by a) r on r.a = s.doc_id
"""


@query
def op6_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return wrappers.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document, and whether it is kept once lines that many documents share are gone."""
    return line_rules.judge(table(spark, sf_dir, "documents")).drop("depleted")


ORACLES["op2_line_frequency"] = """
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text, coalesce(source, '') as host,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from documents
), windows as (
  select r, i, array_to_string(words[i:i + 7], ' ') as w from (select r, words, unnest(range(1, len(words) - 6)) as i from d where len(words) > 8)
), covered as (
  select r, count(distinct p) as n from (
    select r, unnest(range(i, i + 8)) as p from windows where (r, w) in (select (r, w) from windows group by r, w having count(*) > 1)
  ) group by r
), line as (
  select r, host, trim(regexp_replace(lower(x), '[\\x20\\x09\\x0B-\\x0D]+', ' ', 'g')) as x from (select r, host, unnest(lines) as x from d)
), by_host as (select host, x, count(distinct r) as n from line group by host, x),
everywhere as (select x, sum(n) as n from by_host group by x),
heavy as (select host, x from by_host b join everywhere e using (x) where b.n > 10 or e.n > 50),
gone as (select r, sum(len(string_split(x, ' ')))::bigint as n from line join heavy using (host, x) group by r),
m as (
  select d.doc_id, len(words)::bigint as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(covered.n, 0)::bigint as n_repeat_words, coalesce(gone.n, 0)::bigint as n_removed_words
  from d left join covered using (r) left join gone using (r)
)
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and not (n_words - n_removed_words < 0.5 * n_words) as kept
from m
"""


@query
def op13_sibling_shift_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle manifest of all documents, and each one held against it after some texts lost their line ends."""
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", source="source", lang="lang", n_chars="n_chars", text="text")
    before = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = merkle.leaf_of(*before, F.col("text"))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    after = F.when(tampered, merkle.leaf_of(*before, F.translate("text", "\n", ""))).otherwise(leaf)
    rows = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("g"), leaf.alias("leaf"), after.alias("after"))
    found = merkle.manifest(rows, arity=3, carry=("after",))
    return found.select(
        F.col("id").alias("doc_id"), merkle.text_of("leaf").alias("leaf"), merkle.text_of("top").alias("subroot"), merkle.text_of("root").alias("root"),
        F.sha2(merkle.proof_of(F.col("path")), 256).alias("proof_sha256"), merkle.folded(F.col("path"), F.col("after")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLES["op13_sibling_shift_manifest"] = """
with recursive f as (
  select doc_id, source, text, list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
    lambda crc, c: list_reduce(range(8)::bigint[], lambda v, i: xor(v >> 1, 3988292384 * (v & 1)), xor(crc, c)), 4294967295::bigint) as crc,
    array_to_string(list_transform([doc_id::varchar, source, lang, n_chars::varchar], lambda x: coalesce(octet_length(encode(x)) || ':' || x, '-')), '') as head
  from documents
), l as (
  select doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) as leaf,
    sha256(head || coalesce(octet_length(encode(t)) || ':' || t, '-')) as after
  from (select *, case when crc % 2 = 1 then replace(text, chr(10), '') else text end as t from f)
), p as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by source) as n from l
), up(lvl, source, idx, n, h) as (
  select 0, source, idx, n, leaf from p
  union all
  select lvl + 1, source, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' order by idx)) from up where n > 1 group by lvl, source, idx // 3
), tops as (select source, h, row_number() over (order by source nulls first) - 1 as idx, count(*) over () as n from up where n = 1),
over_tops(lvl, idx, n, h) as (
  select 0, idx, n, h from tops
  union all
  select lvl + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' order by idx)) from over_tops where n > 1 group by lvl, idx // 3
), sib as (
  select lvl, source, idx, coalesce(string_agg(h, '' ) over (partition by lvl, source, idx // 3 order by idx rows between unbounded preceding and 1 preceding), '') as l,
    coalesce(string_agg(h, '') over (partition by lvl, source, idx // 3 order by idx rows between 1 following and unbounded following), '') as r
  from up where n > 1
), over_sib as (
  select lvl, idx, coalesce(string_agg(h, '' ) over (partition by lvl, idx // 3 order by idx rows between unbounded preceding and 1 preceding), '') as l,
    coalesce(string_agg(h, '') over (partition by lvl, idx // 3 order by idx rows between 1 following and unbounded following), '') as r
  from over_tops where n > 1
), walk(doc_id, source, leaf, idx, i, lvl, h, proof) as (
  select doc_id, source, leaf, idx, idx, 0, after, '' from p
  union all
  select doc_id, w.source, leaf, w.idx, i // 3, w.lvl + 1, sha256(l || h || r), proof || l || r
  from walk w join sib s on s.source is not distinct from w.source and s.lvl = w.lvl and s.idx = w.i
), arrived as (select w.*, tops.idx as place, tops.h as subroot from walk w join tops on tops.source is not distinct from w.source
  where w.lvl = (select max(lvl) from up where up.source is not distinct from w.source)
), over_walk(doc_id, leaf, subroot, i, lvl, h, proof) as (
  select doc_id, leaf, subroot, place, 0, h, proof from arrived
  union all
  select doc_id, leaf, subroot, i // 3, w.lvl + 1, sha256(l || h || r), proof || l || r from over_walk w join over_sib s on s.lvl = w.lvl and s.idx = w.i
)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, h as folded_root, h = root as verified
from over_walk, (select h as root from over_tops where n = 1) where lvl = (select max(lvl) from over_tops)
"""


@query
def op11_subset_sum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source, with the words that the mix takes of each."""
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", source="source", text="text")
    return mixing.mix(docs.select("doc_id", "source", mixing.words_in(F.col("text")).alias("size"))).drop("source")


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth row for each of its nearest rows of the same label."""
    rows = negatives.usable(table(spark, sf_dir, "embeddings"))
    rows = rows.selectExpr("row", "vec_id", "if(vec_id % 7 = 0, (label + 1) % 10, label) as label", "x", "vec_id % 50 = 0 as anchor")
    return negatives.mine(materialize(rows, "vectors"))


ORACLES["op12_hard_negatives"] = """
with e as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.r as a, a.vec_id as anchor_id, a.label as own, b.vec_id, b.label,
    coalesce(list_sum(list_transform(range(1, least(len(a.q), len(b.q)) + 1), lambda i: a.q[i] * b.q[i])), 0)::bigint as score
  from e a join e b on a.r <> b.r where a.vec_id % 50 = 0
), p as (
  select a, anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by a order by score desc, vec_id) as i
  from s where own = label
)
select p.anchor_id, positive_id, (row_number() over (partition by p.a, p.i order by s.score desc, s.vec_id))::int as rank,
  s.vec_id as negative_id, positive_score, s.score as negative_score
from p join s on s.a = p.a and s.own <> s.label and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score
where p.i <= 5
qualify rank <= 3
"""
