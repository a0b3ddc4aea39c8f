"""Identifiers, joins, unions, splits, parameter statistics and prefix operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlark.functions.expressions import DUCK, tidy, u32_hash
from meshlark.operators import tables as T

HELD = 8


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extract_trailing_id(spark, sf_dir):
    part, pages = _read(spark, sf_dir, "part"), _read(spark, sf_dir, "pages")
    names = part.selectExpr("'part' as kind", "p_partkey as id", "p_brand as name").union(pages.selectExpr("'page'", "page_id", "url"))
    return names.select("kind", "id", T.trailing_id(F.col("name")).cast("long").alias("trailing"))


def delimited_params(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    lines = part.select(F.concat(F.lit("  run_id"), "p_partkey", F.lit("   "), "p_size", F.lit(" "), F.col("p_retailprice").cast("string"), F.lit("  "), F.length("p_name"), F.lit(" "), F.col("p_partkey") % 10).alias("line"))
    return T.parse_delimited(lines, "line").select(F.col("mesh_id").cast("long").alias("mesh_id"), *(F.col("p")[i].alias(f"p{i + 1}") for i in range(4)))


def param_join_audit(spark, sf_dir):
    got = T.integrity_join(_read(spark, sf_dir, "customer"), _read(spark, sf_dir, "orders"), "c_custkey", "o_custkey")
    return got.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if("matched").alias("matched"), F.sum(F.when(~F.col("matched"), F.col("c_custkey")).otherwise(0)).alias("lost"))


def batch_union(spark, sf_dir):
    one = _read(spark, sf_dir, "customer").selectExpr("c_custkey as id", "c_acctbal as value")
    two = _read(spark, sf_dir, "part").selectExpr("p_partkey as id", "p_retailprice as value")
    return T.union_batches(one, two).select(F.col("batch").cast("long").alias("batch"), "id", "value")


def dedupe_last_by_key(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return T.last_by_key(orders, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


def split_train_val_test(spark, sf_dir):
    return T.positional_split(_read(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", HELD).select("vec_id", "split")


def first_test_mesh(spark, sf_dir):
    """The first row of the test split."""
    rows = T.positional_split(_read(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", HELD).where("split = 'test'")
    return T.first_row(rows, "vec_id").selectExpr("vec_id", "cast(label as bigint) as label")


def param_mean_std(spark, sf_dir):
    rows = T.positional_split(_read(spark, sf_dir, "embeddings"), "vec_id", HELD).where("split <> 'test'")
    return T.parameter_statistics(rows, "embedding", 4).selectExpr("cast(dim as bigint) as dim", f"{tidy('mean')} as mean", f"{tidy('std')} as std")


def param_standardise(spark, sf_dir):
    got = T.standardise(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 4)
    return got.selectExpr("vec_id", *(f"{tidy(f'p[{i}]')} as p{i + 1}" for i in range(4)))


def shuffle_order(spark, sf_dir):
    """Deterministic shuffle keys of an epoch: rows sort by the hash of (id, epoch)."""
    return _read(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{u32_hash('(o_orderkey * 2654435761 + 7) & 4294967295')} as key")


def prefix_xor_events(spark, sf_dir):
    events = _read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    got = T.prefix_xor(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "click")
    return got.selectExpr("event_id", "state")


def prefix_offsets_events(spark, sf_dir):
    return T.counts_and_offsets(_read(spark, sf_dir, "events").select("event_type", "user_id"), "user_id", "event_type")


def best_checkpoint(spark, sf_dir):
    events = _read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    got = T.running_best(events, ["user_id"], ["ts", "event_id"], "value")
    return got.selectExpr("event_id", f"{tidy('best')} as best", "improved")


def clamped_l1(spark, sf_dir):
    """Clamped distance error of line items (discount against tax, as values of two models)."""
    d = 0.05
    clip = lambda c: F.greatest(F.lit(-d), F.least(F.lit(d), F.col(c) - 0.04))
    rows = _read(spark, sf_dir, "lineitem").select("l_suppkey", F.abs(clip("l_discount") - clip("l_tax")).alias("e"))
    return rows.groupBy("l_suppkey").agg(F.avg("e").alias("loss")).selectExpr("l_suppkey", f"{tidy('loss')} as loss")


def dataset_loss(spark, sf_dir):
    """Mean over groups of group means."""
    return clamped_l1(spark, sf_dir).agg(F.avg("loss").alias("loss")).selectExpr(f"{tidy('loss', 5)} as loss")


QUERIES = {f.__name__: f for f in (extract_trailing_id, delimited_params, param_join_audit, batch_union, dedupe_last_by_key, split_train_val_test, first_test_mesh, param_mean_std, param_standardise, shuffle_order, prefix_xor_events, prefix_offsets_events, best_checkpoint, clamped_l1, dataset_loss)}

_CLAMP = "select l_suppkey, round(avg(abs(greatest(-0.05e0, least(0.05e0, l_discount - 0.04e0)) - greatest(-0.05e0, least(0.05e0, l_tax - 0.04e0)))), 6) + 0e0 as loss from lineitem group by 1"
_STATS = ", ".join(f"avg(embedding[{i}]::double) as m{i}, stddev_samp(embedding[{i}]::double) as s{i}" for i in range(1, 5))
ORACLES = {
    "extract_trailing_id": "select kind, id, coalesce(try_cast(nullif(regexp_extract(name, '([0-9]+)$', 1), '') as integer), 0)::bigint as trailing from (select 'part' as kind, p_partkey as id, p_brand as name from part union all select 'page', page_id, url from pages)",
    "delimited_params": "select p_partkey as mesh_id, p_size::double as p1, p_retailprice as p2, length(p_name)::double as p3, (p_partkey % 10)::double as p4 from part",
    "param_join_audit": "select c_mktsegment, count(*) as n, count(*) filter (o is not null) as matched, sum(case when o is null then c_custkey else 0 end)::bigint as lost from customer left join (select distinct o_custkey as o from orders) on o = c_custkey group by 1",
    "batch_union": "select 1::bigint as batch, c_custkey as id, c_acctbal as value from customer union all select 2, p_partkey, p_retailprice from part",
    "dedupe_last_by_key": "select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1",
    "split_train_val_test": f"select vec_id, case when r <= {HELD} then 'test' when r <= {2 * HELD} then 'val' else 'train' end as split from (select vec_id, row_number() over (order by vec_id desc) as r from embeddings)",
    "first_test_mesh": f"select vec_id, label::bigint as label from (select * from embeddings order by vec_id desc limit {HELD}) order by vec_id limit 1",
    "param_mean_std": f"with e as (select embedding, row_number() over (order by vec_id desc) as r from embeddings), s as (select {_STATS} from e where r > {HELD}) " + " union all ".join(f"select {i}::bigint as dim, round(m{i}, 6) + 0e0 as mean, round(s{i}, 6) + 0e0 as std from s" for i in range(1, 5)),
    "param_standardise": f"with s as (select {_STATS} from embeddings) select vec_id, " + ", ".join(f"round((embedding[{i}]::double - m{i}) / s{i}, 6) + 0e0 as p{i}" for i in range(1, 5)) + " from embeddings, s",
    "shuffle_order": f"select o_orderkey, {u32_hash('((o_orderkey * 2654435761 + 7) & 4294967295)', DUCK)} as key from orders",
    "prefix_xor_events": "select event_id, (sum((event_type = 'click')::bigint) over (partition by user_id order by ts, event_id rows unbounded preceding) % 2)::bigint as state from events",
    "prefix_offsets_events": "select event_type, user_id, n, (sum(n) over (partition by user_id order by event_type rows unbounded preceding) - n + 1)::bigint as first from (select event_type, user_id, count(*) as n from events group by 1, 2)",
    "best_checkpoint": "select event_id, round(min(value) over w, 6) + 0e0 as best, coalesce(value < min(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), true) as improved from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)",
    "clamped_l1": _CLAMP,
    "dataset_loss": f"select round(avg(loss), 5) + 0e0 as loss from ({_CLAMP})",
}
