"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame operations only).

The mix has 150 % of the corpus' words, shared among sources by weight; no source may give more than
twice its words, what it cannot give is reshared by weight.  The mix is then cut into blocks of equal
size.  Blocks go to sources by highest quotients target / (2k - 1), and each source's blocks go to its
shards by highest quotients words / (2k - 1), which gives an integer quota for every shard.  A shard
lays its documents end to end in a seeded order and takes its quota of blocks from that line: every
block quota // blocks times, and the rest once, from the front.  The seed's order makes this a random choice
of blocks that keeps documents whole but for one a shard, and the words a document gives follow from its place
in the line alone, so no row is made per block.

Only (doc_id, source, size, order) is carried; text is read once.  A shard holds a bounded share of a source
(words_per_shard, until max_shards), so a source with a third of all rows is as many tasks as it has
shards; a document's shard follows from its id, its text and its number among equal rows, so no id, null or
repeated, fills a shard.  The tables of sources and shards have a row for each; they are broadcast only when counted
and small.  Targets rank all sources, and quotas a source's shards, in one task: rows of some 50 bytes, so
millions of sources are sorted in seconds, but billions would not be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, bounded, materialize, n_words, own_name

#: Fixed values of the mix.
WEIGHTS = (5, 2, 1)
CAP = 2
SEED = 20240101
BLOCK_WORDS = 16
WORDS_PER_SHARD = 1_000_000
MAX_SHARDS = 1 << 16


def target_shares(sources: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Adds source_no (1 for the first by code point, null last), target (double) and the number of words
    of the mix, mix_words2, doubled so that it is whole.

    Water filling in closed form: with sources in ascending order of cap / weight, those before the
    first that its share of what is left doesn't fill are at their cap, the rest share by weight.
    """
    everything = W.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("source_no", F.row_number().over(by_name).cast("long"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_no") - 1) % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * CAP)
    fill = everything.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source_no"))
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    s = s.select(
        "*",
        (F.sum("source_size").over(everything) * 3).alias("mix_words2"),
        F.row_number().over(fill).alias("_k"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("_capped"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("_weights"),
    )
    left = F.col("mix_words2") - 2 * F.col("_capped")
    fits = left.cast("double") * F.col("weight") <= F.lit(2.0) * F.col("cap") * F.col("_weights")
    first = F.min(F.when(fits, F.struct("_k", left.alias("left"), F.col("_weights").alias("weights")))).over(everything)
    s = s.withColumn("_first", first)
    share = (F.col("weight") * F.col("_first.left")).cast("double") / (F.lit(2) * F.col("_first.weights"))
    target = F.when(F.col("_k") < F.col("_first._k"), F.col("cap").cast("double")).otherwise(share)
    return s.withColumn("target", F.coalesce(target, F.lit(0.0))).select("source", "source_no", "source_size", "target", "mix_words2")


def sainte_lague(parts: DataFrame, group: str, key: str, weight: str, seats: str, quota: str) -> DataFrame:
    """Adds `quota`: how many of the group's `seats` go to each part by the highest quotients
    weight / 1, weight / 3, weight / 5 ...; equal quotients go to the smaller key.

    Of n parts none ends further than weight / total * n / 2 + 1 from its exact share, so seats below
    that are given at once and only the quotients around it (3 n in a group) are ranked.
    """
    whole = W.partitionBy(group)
    share = F.col(weight).cast("double") / F.sum(F.col(weight).cast("double")).over(whole)
    near = parts.withColumn("_share", F.coalesce(F.when(F.col(weight) > 0, share), F.lit(0.0)))
    near = near.withColumn("_r", F.ceil(F.col("_share") * F.count(F.lit(1)).over(whole) / 2).cast("long") + 2)
    near = near.withColumn("_mid", F.floor(F.col("_share") * F.col(seats)).cast("long"))
    near = near.withColumn("_sure", F.when(F.col(weight) > 0, F.greatest(F.col("_mid") - F.col("_r"), F.lit(0))).otherwise(F.lit(0)).cast("long"))
    near = near.withColumn("_open", F.col(seats) - F.sum("_sure").over(whole))
    ask = near.where(F.col(weight) > 0).select(group, key, "_open", F.col(weight).alias("_w"), F.explode(F.sequence(F.col("_sure") + 1, F.col("_mid") + F.col("_r"))).alias("_seat"))
    ask = ask.withColumn("_q", F.col("_w").cast("double") / (2 * F.col("_seat") - 1))
    ask = ask.withColumn("_rank", F.row_number().over(whole.orderBy(F.col("_q").desc(), F.col(key), F.col("_seat"))))
    won = ask.where("_rank <= _open").groupBy(group, key).agg(F.count(F.lit(1)).alias("_won"))
    out = near.join(won, [group, key], "left").withColumn(quota, F.col("_sure") + F.coalesce("_won", F.lit(0)))
    return out.drop("_share", "_r", "_mid", "_sure", "_open", "_won")


def _numbered(sized: DataFrame) -> DataFrame:
    """Rows of the written table with _order told apart for equal rows (of one source, id and text): the first keeps
    it, each further one has that of its number among them.  Numbers run through each partition of the table and
    then through the partitions, so a document with most of all rows is as many tasks as it has partitions."""
    part = F.shiftright("_n", 33)
    counted = sized.groupBy("source", "_order", part.alias("_part")).agg(F.count(F.lit(1)).alias("_k"))
    whole = W.partitionBy("source", "_order")
    before = F.coalesce(F.sum("_k").over(whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    again = counted.select("*", before.alias("_before"), F.sum("_k").over(whole).alias("_all")).where("_all > 1")
    again = bounded(materialize(again.select(F.col("source").alias("_s"), F.col("_order").alias("_o"), F.col("_part").alias("_p"), "_before"), "mix-repeats"))
    same = (sized["_order"] == again["_o"]) & (part == again["_p"]) & sized["source"].eqNullSafe(again["_s"])
    rows = sized.join(again, same, "left")
    once = rows.where("_o is null").select(*sized.columns)
    nth = F.row_number().over(W.partitionBy("_s", "_o", "_p").orderBy("_n")) - 1 + F.col("_before")
    many = rows.where("_o is not null").withColumn("_nth", nth)
    told = F.when(F.col("_nth") == 0, F.col("_order")).otherwise(F.md5(F.concat("_order", F.lit(":"), F.col("_nth").cast("string"))))
    return once.unionByName(many.withColumn("_order", told).select(*sized.columns))


def mix_sources(docs: DataFrame, *, seed: int = SEED, block_words: int = BLOCK_WORDS, words_per_shard: int = WORDS_PER_SHARD, max_shards: int = MAX_SHARDS) -> DataFrame:
    """One row for each row of docs (doc_id, text, source): doc_id, size, source_size, target and taken, which is
    rounds times all its words and once its first `once` words.

    A null text has size 0 and gives nothing, a null source is a source of its own and the last; repeated
    rows are documents of their own, and so are those of a null id: a document's place follows from its id and text,
    and from its number among equal rows.  An empty table gives an empty result.  Further columns of docs do not
    enter, whatever their names, but for _n, which apply_mix() adds.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))
    number = F.col("_n") if "_n" in docs.columns else F.monotonically_increasing_id()
    sized = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), order.alias("_order"), number.alias("_n")), "mix-sizes")
    sources = target_shares(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = sources.withColumn("_all", F.lit(0)).withColumn("_seats", F.floor(F.col("mix_words2") / (2 * block_words)).cast("long"))
    sources = sainte_lague(sources, "_all", "source_no", "target", "_seats", "source_quota")
    shards_of = F.least(F.greatest(F.ceil(F.col("source_size") / words_per_shard), F.lit(1)), F.lit(max_shards)).cast("long")
    sources = materialize(sources.select("source", "source_no", "source_size", "target", "source_quota", shards_of.alias("n_shards")), "mix-sources")

    named = bounded(sources.withColumnRenamed("source", "_source"))
    rows = _numbered(sized)
    dealt = rows.join(named, rows["source"].eqNullSafe(named["_source"])).drop("_source", "source")
    dealt = dealt.withColumn("shard", F.conv(F.substring("_order", 25, 8), 16, 10).cast("long") % F.col("n_shards"))
    shards = dealt.groupBy("source_no", "shard", "source_quota").agg(F.sum("size").alias("shard_size"))
    shards = sainte_lague(shards, "source_no", "shard", "shard_size", "source_quota", "_asked")
    shards = shards.withColumn("blocks", F.ceil(F.col("shard_size") / block_words).cast("long"))
    shards = shards.withColumn("quota", F.least("_asked", F.col("blocks") * CAP))
    shards = materialize(shards.select("source_no", "shard", "blocks", "quota"), "mix-shards")

    line = W.partitionBy("source_no", "shard").orderBy("_order", "_n").rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("start", F.coalesce(F.sum("size").over(line), F.lit(0))).join(bounded(shards), ["source_no", "shard"])
    rounds = F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0).cast("long")
    front = F.col("quota") % F.greatest("blocks", F.lit(1)) * block_words
    placed = placed.withColumns({"rounds": rounds, "once": F.greatest(F.least("size", front - F.col("start")), F.lit(0)).cast("long")})
    return placed.withColumn("taken", F.col("rounds") * F.col("size") + F.col("once")).select("doc_id", "size", "source_size", "target", "taken", "rounds", "once", "_n")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, with all white space before that."""
    words = F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), n.cast("int"))
    gaps = F.slice(F.split(text, WORD, -1), F.lit(1), n.cast("int"))
    length = F.aggregate(F.zip_with(gaps, words, lambda g, w: F.length(g) + F.length(w)), F.lit(0), lambda total, x: total + x)
    return F.substring(text, F.lit(1), length)


def apply_mix(docs: DataFrame, *, seed: int = SEED, block_words: int = BLOCK_WORDS, words_per_shard: int = WORDS_PER_SHARD) -> DataFrame:
    """The mix itself, with the columns of docs: a document that is taken whole twice gives two rows, and the
    one at which a shard's choice ends gives its text up to there, white space kept.  Rows that give no word
    go; so does a document without words, since it has nothing to give.  A null source is a source, repeated
    rows are documents of their own, an empty table stays empty, columns keep their values whatever their names."""
    keep, number = docs.columns, own_name("_n", docs.columns)
    # written with a number for each row, by which the plan finds its text again: texts are never sorted
    held = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "mix-rows")
    plan = mix_sources(held.select("doc_id", "text", "source", F.col(number).alias("_n")), seed=seed, block_words=block_words, words_per_shard=words_per_shard)
    plan = plan.where("taken > 0").select("_n", "size", "rounds", "once").hint("shuffle_hash")
    placed = held.select(F.col(number).alias("_n"), F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_row")).join(plan, "_n")
    text = F.col("_row.text")
    part = F.when(F.col("once") == F.col("size"), text).when(F.col("once") > 0, first_words(text, F.col("once")))
    texts = F.concat(F.array_repeat(text, F.col("rounds").cast("int")), F.filter(F.array(part), lambda t: t.isNotNull()))
    out = placed.select("_row", F.explode(texts).alias("_text"))
    new = {c: F.col("_row")[c] for c in keep} | {"text": F.col("_text")}
    if "n_chars" in keep:
        new["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(v.alias(c) for c, v in new.items()))


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    """What every document gives to the mix; see mix_sources() for nulls, empties and repeats."""
    from .common import read

    return mix_sources(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, size, CASE WHEN copy = 1 THEN o ELSE md5(o || ':' || (copy - 1)) END AS o FROM (
    SELECT *, row_number() OVER (PARTITION BY source, o) AS copy FROM (
      SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS o FROM documents))
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS source_no FROM sized GROUP BY source
), weighted AS (
  SELECT *, [5, 2, 1][((source_no - 1) % 3 + 1)::INT]::BIGINT AS weight, source_size * 2 AS cap FROM src
), filled AS (
  SELECT *, 3 * sum(source_size) OVER () AS mix2,
    row_number() OVER (ORDER BY cap / weight, source_no) AS k,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights
  FROM weighted
), stop AS (
  SELECT k AS k0, mix2 - 2 * capped AS remaining, weights AS w0 FROM filled
  WHERE (mix2 - 2 * capped)::DOUBLE * weight <= 2.0::DOUBLE * cap * weights ORDER BY k LIMIT 1
), targets AS (
  SELECT source, source_no, source_size, CASE WHEN k < k0 THEN cap::DOUBLE ELSE (weight * remaining)::DOUBLE / (2 * w0)::DOUBLE END AS target,
    floor(mix2::DOUBLE / {2 * BLOCK_WORDS})::BIGINT AS seats FROM filled, stop
), ask AS (
  SELECT source_no, seats, target / (2 * seat - 1) AS q, seat FROM (
    SELECT source_no, target, seats, unnest(range(1, (floor(target / sum(target) OVER () * seats) + count(*) OVER () + 4)::BIGINT)) AS seat FROM targets WHERE target > 0)
), quotas AS (
  SELECT source_no, count(*) AS source_quota FROM (SELECT *, row_number() OVER (ORDER BY q DESC, source_no, seat) AS r FROM ask) WHERE r <= seats GROUP BY source_no
), dealt AS (
  SELECT d.doc_id, d.size, t.source_no, t.source_size, t.target, coalesce(q.source_quota, 0) AS source_quota, d.o,
    ('0x' || substr(d.o, 25, 8))::BIGINT % least(greatest(ceil(t.source_size::DOUBLE / {WORDS_PER_SHARD}), 1), {MAX_SHARDS})::BIGINT AS shard
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN quotas q USING (source_no)
), shards AS (
  SELECT source_no, shard, source_quota, sum(size)::BIGINT AS w FROM dealt GROUP BY ALL
), sask AS (
  SELECT source_no, shard, source_quota, w::DOUBLE / (2 * seat - 1) AS q, seat FROM (
    SELECT *, unnest(range(1, (floor(w / sum(w) OVER (PARTITION BY source_no) * source_quota) + count(*) OVER (PARTITION BY source_no) + 4)::BIGINT)) AS seat FROM shards WHERE w > 0)
), squotas AS (
  SELECT source_no, shard, count(*) AS asked FROM (SELECT *, row_number() OVER (PARTITION BY source_no ORDER BY q DESC, shard, seat) AS r FROM sask) WHERE r <= source_quota GROUP BY ALL
), lined AS (
  SELECT s.source_no, s.shard, ceil(w / {BLOCK_WORDS}.0)::BIGINT AS blocks, least(coalesce(asked, 0), 2 * ceil(w / {BLOCK_WORDS}.0)::BIGINT) AS quota
  FROM shards s LEFT JOIN squotas USING (source_no, shard)
), placed AS (
  SELECT d.*, l.quota, greatest(l.blocks, 1) AS nb, coalesce(sum(size) OVER (PARTITION BY d.source_no, d.shard ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
  FROM dealt d JOIN lined l USING (source_no, shard)
)
SELECT doc_id, size, source_size, target, ((quota // nb) * size + greatest(0, least(size, (quota % nb) * {BLOCK_WORDS} - a)))::BIGINT AS taken
FROM placed
"""
