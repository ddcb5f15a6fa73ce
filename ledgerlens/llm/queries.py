"""The registered queries of the text operators, with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.llm import conversations, dartminhash, decontaminate, hard_negatives, htmltree, kmeans_tree, language, lines, mixing, packing, quality_net, secrets, sharding
from ledgerlens.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train_language_model(docs)
    return language.predict_language(docs, model).select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


LINES_SQL = r"""
with split as (
  select doc_id, source, text, string_split(text, chr(10)) as lines from documents
), held as (
  select source, unnest(list_distinct(lines)) as line from split where source is not null
), counts as (
  select source, line, count(*) as n from held where regexp_matches(line, '[^\x20\x09-\x0D]') group by source, line
), totals as (
  select source, count(*) as pages from documents where source is not null group by source
), boilerplate as (
  select source, list(line) as gone from counts join totals using (source)
  where n > 0.05::double * (pages + 40) group by source
), cut as (
  select doc_id, text, lines,
    case when gone is null then lines else [l for l in lines if not list_contains(gone, l)] end as kept
  from split left join boilerplate using (source)
)
select doc_id, array_to_string(kept, chr(10)) as text, cast(coalesce(len(lines), 0) as integer) as n_lines,
  cast(coalesce(len(lines) - len(kept), 0) as integer) as n_dropped
from cut
"""


@query("op2_line_dedup", LINES_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text")) \
        .select("doc_id", "text", "n_lines", "n_dropped")


@query("op3_secret_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    dictionary = secrets.frequent_words(docs)
    model = secrets.train_forest(secrets.labelled_findings(spark, dictionary=dictionary), dictionary)
    return secrets.scan(docs, model, dictionary).select("doc_id", "word_no", "candidate", "score", "is_secret")


@query("op4_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), n_shards=40)
    return sharded.select(
        "doc_id", sharding.record_size(F.col("text")).alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_net.train_quality_model(docs, table(spark, sf_dir, "labels"))
    return quality_net.score_quality(docs, model).select(
        "doc_id", quality_net.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op7_minhash_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


MIXING_SQL = r"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size
  from documents
), sources as (
  select source, cast(sum(size) as bigint) as source_size,
    case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight
  from sized group by source
), by_reach as (
  select *, coalesce(sum(source_size) over w, 0) as given,
    sum(weight) over () - coalesce(sum(weight) over w, 0) as open_weight, sum(source_size) over () as total
  from sources
  window w as (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)
), levels as (
  select *, (1.5::double * total - 2.0::double * given) / open_weight as level from by_reach
), chosen as (
  select level from levels where level * weight <= 2.0::double * source_size
  order by source_size / weight, source nulls last limit 1
), targets as (
  select source, source_size, least(2.0::double * source_size, coalesce(c.level, 0) * weight) as target
  from sources cross join chosen c
), placed as (
  select s.doc_id, s.size, t.source_size, t.target,
    case when t.source_size > 0 then t.target / t.source_size else 0.0::double end as rate,
    row_number() over (partition by s.source order by s.size, md5('mix-1:' || coalesce(cast(s.doc_id as varchar), ''))) - 1 as place,
    cast(('0x' || substr(md5('mix-1:' || coalesce(s.source, '')), 1, 8)) as bigint) / 4294967296.0::double as shift
  from sized s join targets t on s.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  size * cast(least(2, floor(after) + floor(after - floor(after) + shift) - floor(before) - floor(before - floor(before) + shift)) as bigint)
    as taken
from (select *, (place + 1)::double * rate as after, place::double * rate as before from placed)
"""


@query("op9_source_mixing", MIXING_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    mixed = mixing.mix_sources(sized, size=F.col("size"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op10_decontamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_nearest_neighbours")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kmeans_tree.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op6_html_extraction")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return htmltree.extract_text(pages, htmltree.default_potentials()).select("page_id", "url", "text", "n_chars")


@query("op11_best_fit_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


# The checksum bit by bit, then the cheapest edits row by row. A state holds cost, audit and repaired text
# in one string; the least string is the cheapest, then the first audit.
REPAIR_SQL = r"""
with recursive hashed as (
  select *, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as name from conversations
), bits as (
  select distinct name, list_reduce(list_prepend(cast(4294967295 as bigint), [cast(ascii(c) as bigint) for c in string_split(name, '')]),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [cast(b as bigint) for b in range(8)]),
      lambda r, b: case when r % 2 = 1 then xor(r // 2, 3988292384) else r // 2 end)) as r
  from hashed
), kinds as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, xor(r, 4294967295) % 20 as kind
  from hashed join bits using (name)
), damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case kind when 3 then [1, 2] else [1] end) as copy
  from kinds where kind <> 0
), ordered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, md5(length(role) || ':' || role || ':' || text)) as i
  from damaged
), counted as (
  select *, row_number() over (partition by conv_id, role, text order by i) as nth from ordered
), marked as (
  select *, left(role, 1) as initial, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b' when nth > 1 then 'd'
    when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 't' else '' end as fault
  from counted
), stats as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank,
    count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated, count(*) as n
  from marked group by conv_id
), pairs as (
  select conv_id, initial || lead(initial) over (partition by conv_id order by i) as pair from marked
), wrong as (
  select conv_id, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal from pairs group by conv_id
), conv as (
  select distinct c.conv_id, coalesce(n, 0) as n from conversations c left join stats s on c.conv_id is not distinct from s.conv_id
), walk as (
  -- Columns: the best way to each state, as cost (8 digits), audit, bar, repaired text.
  select conv_id, n, cast(0 as bigint) as i, '00000000|' as start_, cast(null as varchar) as system_,
    '00000005I|user:' as user_, '00000010II|user:' || chr(10) || 'assistant:' as assistant_ from conv
  union all
  select conv_id, n, i, s0, ss, u2, least(a1, step(u2, 5, 'I', 'assistant:', true)) from (
    select *, least(u1, step(s0, 5, 'I', 'user:', true), step(ss, 5, 'I', 'user:', true), step(a1, 5, 'I', 'user:', true)) as u2 from (
      select w.conv_id, w.n, w.i + 1 as i,
        step(start_, 2, 'D', '', false) as s0,
        least(step(system_, 2, 'D', '', false), case when ok and initial = 's' then step(start_, extra, 'K', own, true) end) as ss,
        least(step(user_, 2, 'D', '', false),
          case when ok and initial = 'u' then least(step(start_, extra, 'K', own, true), step(system_, extra, 'K', own, true), step(assistant_, extra, 'K', own, true)) end,
          case when ok then least(step(start_, extra + 1, 'R', new_user, true), step(system_, extra + 1, 'R', new_user, true), step(assistant_, extra + 1, 'R', new_user, true)) end) as u1,
        least(step(assistant_, 2, 'D', '', false), case when ok and initial = 'a' then step(user_, extra, 'K', own, true) end,
          case when ok then step(user_, extra + 1, 'R', new_assistant, true) end) as a1
      from walk w join (select conv_id, i, initial, fault not in ('b', 'd') as ok, case fault when 't' then 5 else 0 end as extra,
          role || ':' || text as own, 'user:' || text as new_user, 'assistant:' || text as new_assistant from marked) m
        on w.conv_id is not distinct from m.conv_id and m.i = w.i + 1))
), best as (
  select conv_id, least(start_, assistant_) as way from walk where i = n
)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cast(left(way, 8) as bigint) as cost,
  substr(way, 9, strpos(way, '|') - 9) as audit, sha256(substr(way, strpos(way, '|') + 1)) as repaired_sha256
from conv c join best b on c.conv_id is not distinct from b.conv_id
  left join stats s on c.conv_id is not distinct from s.conv_id left join wrong w on c.conv_id is not distinct from w.conv_id
"""


def _steps_written_out(sql: str) -> str:
    """Writes each step(way, cost, edit, line, adds a line) out as SQL."""
    def step(m: re.Match) -> str:
        way, cost, edit, line, adds = (p.strip() for p in m.groups())
        text = f"substr({way}, strpos({way}, '|') + 1)"
        more = f"|| case when {text} = '' then '' else chr(10) end || {line}" if adds == "true" else ""
        return (f"(lpad(cast(cast(left({way}, 8) as bigint) + {cost} as varchar), 8, '0') || "
                f"substr({way}, 9, strpos({way}, '|') - 9) || {edit} || '|' || {text} {more})")

    return re.sub(r"step\((\w+), ([\w +]+), ('\w'), ([^,]+), (true|false)\)", step, sql)


@query("op12_conversation_repair", _steps_written_out(REPAIR_SQL))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damage(table(spark, sf_dir, "conversations"))
    return conversations.repair_conversations(rows).withColumnRenamed("conv", "conv_id")


NEGATIVES_SQL = r"""
with whole as (
  select vec_id, case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else label end as label,
    [cast(floor(256 * cast(x as double)) as double) for x in embedding] as v
  from embeddings
  where label is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), scored as (
  select a.vec_id as anchor_id, a.label <> r.label as differs, r.vec_id, cast(list_inner_product(a.v, r.v) as bigint) as score
  from whole a join whole r on a.vec_id <> r.vec_id where a.vec_id % 50 = 0
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where not differs
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, positive_id,
  cast(row_number() over (partition by p.anchor_id, positive_id order by n.score desc, n.vec_id) as integer) as rank,
  n.vec_id as negative_id, positive_score, n.score as negative_score
from positives p join scored n on p.anchor_id = n.anchor_id and n.differs
  and 50 * positive_score <= 100 * n.score and 100 * n.score <= 95 * positive_score
qualify rank <= 3
"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label)
