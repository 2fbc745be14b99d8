"""Registered queries of the operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeline.llm import bpe, exact, lines, minhash, negatives, packing, pages, quality, secrets, shards, substrings, toxicity, turntrie
from gradeline.session import checkpointed

SHARDS = 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over 4-word shingles at a similarity of 0.8."""
    found = minhash.near_groups(_table(spark, sf_dir, "documents"), minhash.Settings(words=4))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again; digests of the ids and of the decoded bytes."""
    both = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents")))
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2,048 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model learnt from the labelled rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and removed lines of every document, and a digest of what is left of its text."""
    done = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "lines", "lines_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty contiguous shards of near-equal bytes."""
    placed = shards.shards(_table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in secrets.KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["stop"])), ",")


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and a digest of the base spans of every document, and all its spans."""
    found = secrets.secret_spans(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    table = _table(spark, sf_dir, "pages")
    return pages.main_text(table, pages.fit(table))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts of every document, whether it fails the base rules, and whether it is kept."""
    found = quality.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts that are equal without white space, and the row of each that stays."""
    return exact.exact_groups(_table(spark, sf_dir, "documents"))


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    sequences = checkpointed(turntrie.encoded(_table(spark, sf_dir, "conversations")))
    return turntrie.prefix_nodes(turntrie.with_shared_heads(sequences))


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; labels of every seventh move on by one."""
    rows = negatives.usable(_table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumns({"label": moved, "anchor": F.col("vec_id") % 100 == 0}))


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and removed bytes of every document, and a digest of the bytes that no repeated string of 400 bytes covers."""
    done = substrings.without_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                       F.coalesce(F.sha2("kept", 256), F.col("text_sha256")).alias("kept_sha256"))


QUERIES = {
    "op1_minhash_near_dedup": near_duplicates,
    "op2_byte_bpe": byte_bpe,
    "op3_best_fit_packing": best_fit_packing,
    "op4_toxicity": toxicity_scores,
    "op5_line_dedup": line_dedup,
    "op6_byte_shards": byte_shards,
    "op7_secret_scan": secret_scan,
    "op8_html_extraction": html_extraction,
    "op9_quality_rules": quality_rules,
    "op10_exact_dedup": exact_duplicates,
    "op11_conversation_trie": conversation_trie,
    "op12_hard_negatives": hard_negatives,
    "op13_substring_dedup": substring_dedup,
}

_WORD = "[^\\x20\\x09-\\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# The byte table of the checksum, for SQL engines without the function.
_CRC_TABLE = """steps as (
  select i, i::bigint as c, 0 as k from range(256) r(i)
  union all
  select i, xor(c >> 1, (c & 1) * 3988292384), k + 1 from steps where k < 8),
byte_table as (select list(c order by i) as t from steps where k = 8)"""

ORACLES = {
    "op1_minhash_near_dedup": f"""
with recursive worded as (select doc_id, regexp_extract_all({_LOWER}, '{_WORD}') as w from documents),
grams as (
  select doc_id, unnest(list_distinct(case
    when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as g
  from worded),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
shared as (
  select a.doc_id as x, b.doc_id as y, count(*) as k from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (
  select x, y from shared join sizes sx on sx.doc_id = x join sizes sy on sy.doc_id = y where 100 * k >= 80 * (sx.n + sy.n - k)),
both_ways as (select x, y from links union all select y, x from links),
reach as (
  select doc_id, doc_id as other from documents
  union
  select reach.doc_id, both_ways.y from reach join both_ways on reach.other = both_ways.x)
select reach.doc_id, coalesce(max(n), 0) as n_shingles, min(other) as component_id, reach.doc_id = min(other) as kept
from reach left join sizes on sizes.doc_id = reach.doc_id group by reach.doc_id""",
    "op5_line_dedup": f"""
with raw as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as parts, coalesce(text, '') as text from documents),
listed as (select doc_id, unnest(range(len(parts))) as i, unnest(parts) as whole from raw),
worded as (
  select doc_id, i, trim(whole, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as line,
    len(regexp_extract_all(whole, '{_WORD}')) as words
  from listed),
entries as (
  select doc_id, i, line, row_number() over (partition by doc_id order by i) as k, sum(words) over (partition by doc_id order by i) as upto
  from worded where words > 0),
starts as (select *, upto - coalesce(lag(upto) over (partition by doc_id order by k), 0) as words from entries),
spans as (
  select a.doc_id, a.k as a, min(b.k) as b from starts a join starts b on a.doc_id = b.doc_id and b.k >= a.k
    and b.upto - a.upto + a.words >= {lines.MIN_WORDS} group by a.doc_id, a.k
  union
  select b.doc_id, max(a.k) as a, b.k as b from starts a join starts b on a.doc_id = b.doc_id and b.k >= a.k
    and b.upto - a.upto + a.words >= {lines.MIN_WORDS} group by b.doc_id, b.k),
windows as (
  select s.doc_id, s.a, s.b, min(e.i) as start, max(e.i) as stop, string_agg(e.line, chr(10) order by e.k) as body
  from spans s join entries e on e.doc_id = s.doc_id and e.k between s.a and s.b group by s.doc_id, s.a, s.b),
firsts as (
  select *, first_value(doc_id) over w as first_doc, first_value(stop) over w as first_stop
  from windows window w as (partition by body order by doc_id, start, stop)),
gone as (
  select distinct f.doc_id, l.i from firsts f join listed l on l.doc_id = f.doc_id and l.i between f.start and f.stop
  where f.doc_id <> f.first_doc or f.start > f.first_stop),
kept as (
  select l.doc_id, count(g.i) as lines_removed, count(*) as lines,
    coalesce(string_agg(l.whole, chr(10) order by l.i) filter (where g.i is null), '') as rest
  from listed l left join gone g on g.doc_id = l.doc_id and g.i = l.i group by l.doc_id)
select d.doc_id, case when d.text is null then 0 else lines end as lines, lines_removed, sha256(rest) as text_sha256
from documents d join kept using (doc_id)""",
    "op6_byte_shards": f"""
with recursive {_CRC_TABLE},
hexed as (select doc_id, coalesce(text, '') as text, hex(encode(coalesce(text, ''))) as h from documents),
bytes as (
  select doc_id, len(h) // 2 as n, list_transform(range(len(h) // 2), lambda i:
    (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1)::bigint[] as b
  from hexed),
sums as (
  select doc_id, n + 16 as size, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, b),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) as text_crc32
  from bytes, byte_table),
placed as (
  select *, coalesce(sum(size) over (order by doc_id, text_crc32, size rows between unbounded preceding and 1 preceding), 0) as before,
    sum(size) over () as total, row_number() over (order by doc_id, text_crc32, size) as place
  from sums),
cut as (select *, least(floor((before * 2 + size)::double / (2 * total)::double * {SHARDS}), {SHARDS - 1})::int as shard from placed)
select doc_id, size, text_crc32, 'bytes' as law, shard, place - min(place) over (partition by shard) as slot, null::int as grown_shard
from cut""",
    "op10_exact_dedup": """
with stripped as (
  select doc_id, length(coalesce(text, '')) as points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as norm
  from documents),
ranked as (
  select *, first_value(doc_id) over (partition by norm order by points desc, doc_id) as keep_id, count(*) over (partition by norm) as group_size,
    row_number() over (partition by norm order by points desc, doc_id) as place
  from stripped)
select doc_id, keep_id, group_size, place = 1 as kept, sha256(norm) as text_sha256 from ranked""",
    "op11_conversation_trie": f"""
with recursive {_CRC_TABLE},
turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first) as place, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
cut as (
  select conv_id, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % 9 as h
  from (select distinct conv_id from turns), byte_table),
rebuilt as (
  select c.conv_id, place, role, text from cut c join turns t on t.conv_id = c.conv_id - c.conv_id % 5 and place <= h
  union all
  select c.conv_id, place, role, text from cut c join turns t on t.conv_id = c.conv_id and place > h),
listed as (
  select c.conv_id, coalesce(list(sha256(strlen(role) || ':' || role || text) order by place) filter (where place is not null), []) as keys,
    coalesce(list(strlen(text) order by place) filter (where place is not null), []) as sizes
  from cut c left join rebuilt using (conv_id) group by c.conv_id),
steps_of as (select conv_id, keys, sizes, unnest(range(len(keys) + 1)) as depth from listed),
nodes as (
  select array_to_string(keys[1:depth], ',') as node, depth, min(conv_id) as conv_id, count(*) as n_convs, max(coalesce(sizes[depth], 0)) as size,
    case when depth > 0 then array_to_string(any_value(keys)[1:depth - 1], ',') end as up, any_value(keys) as keys,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where len(keys) = depth), '')) as ends_sha256
  from steps_of group by 1, 2),
kids as (select up, count(*) as n_children from nodes where depth > 0 group by up, depth),
sums as (
  select array_to_string(keys[1:d], ',') as node, d as depth, sum((n_convs - 1) * size) as saved_tokens, sum((k is null)::int) as n_leaves
  from (select nodes.keys, n_convs, size, unnest(range(nodes.depth + 1)) as d, kids.n_children as k
    from nodes left join kids on kids.up = nodes.node) group by 1, 2)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::bigint as n_children,
  s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, n.ends_sha256
from nodes n left join nodes p on p.node = n.up and p.depth = n.depth - 1 left join kids k on k.up = n.node join sums s on s.node = n.node and s.depth = n.depth""",
    "op12_hard_negatives": """
with rows as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
anchors as (select * from rows where vec_id % 100 = 0),
scored as (
  select a.r as ar, a.vec_id as anchor_id, b.r as br, b.vec_id, a.label = b.label as alike, list_inner_product(a.v::double[], b.v::double[])::bigint as score
  from anchors a join rows b on a.r <> b.r),
positives as (
  select * from (select *, row_number() over (partition by ar order by score desc, vec_id) as k from scored where alike) where k <= 5),
windows as (
  select p.ar, p.anchor_id, p.k, p.vec_id as positive_id, p.score as positive_score, n.vec_id as negative_id, n.score as negative_score,
    row_number() over (partition by p.ar, p.k order by n.score desc, n.vec_id) as rank
  from positives p join scored n on n.ar = p.ar and not n.alike and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from windows where rank <= 5""",
    "op13_substring_dedup": """
with hexed as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
blocks as (select r, b, substr(h, 2 * b + 1, 1310) as part from (select r, h, unnest(range(0, greatest(len(h) // 2 - 399, 0), 256)) as b from hexed)),
windows as (
  select r, b + i as p, md5(substr(part, 2 * i + 1, 800)) as w
  from (select r, b, part, unnest(range(0, least(256, len(part) // 2 - 399))) as i from blocks)),
again as (select r, p from windows where w in (select w from windows group by w having count(*) > 1)),
marked as (select r, p, case when p > lag(p) over (partition by r order by p) + 400 then 1 else 0 end as fresh from again),
runs as (select r, p, sum(fresh) over (partition by r order by p) as k from marked),
spans as (select r, k, min(p) as a, max(p) + 400 as b from runs group by r, k),
gaps as (select r, k, a, b, coalesce(lag(b) over (partition by r order by a), 0) as prior from spans),
cut as (
  select g.r, sum(b - a) as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * prior + 1, 2 * (a - prior)), '' order by a) as heads, max(b) as last
  from gaps g join hexed on hexed.r = g.r group by g.r)
select doc_id, len(h) // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(heads, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from hexed left join cut on cut.r = hexed.r""",
}
