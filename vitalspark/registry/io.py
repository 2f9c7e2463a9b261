"""Sink queries that read back (SNK-1, SNK-3, SNK-4)."""

from __future__ import annotations

from ..sources import sinks
from .base import register, table


@register("latest_order", "SNK-3",
          "SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM (SELECT *, row_number()"
          " OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def latest_order(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    out = sinks.latest_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return out.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@register("conversation_log", "SNK-4",
          "SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position"
          " FROM conversations")
def conversation_log(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return sinks.ordered_log(c, ["conv_id"], ["turn"]).select("conv_id", "turn", "role", "text", "position")


@register("snapshot_round_trip", "SNK-1",
          "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice, o_orderpriority,"
          " (SELECT count(DISTINCT o_custkey) FROM orders) AS profile_customers FROM orders")
def snapshot_round_trip(spark, sf_dir):
    """Orders saved, replaced by all orders made from the first version and the
    rest, a second snapshot saved and deleted; the rows and a figure of the
    profile as read back."""
    import uuid

    from pyspark.sql import functions as F

    from ..functions.columns import r4
    from ..session import ensure_checkpoint_dir
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/snapshots-{uuid.uuid4().hex}"
    orders, key = table(spark, sf_dir, "orders"), ["o_orderkey"]
    done = F.col("o_orderstatus") == "F"
    sinks.save_snapshot(orders.where(done), base, "orders", key)
    sinks.save_snapshot(sinks.load_snapshot(spark, base, "orders").unionByName(orders.where(~done)), base, "orders", key)
    sinks.drop_old_versions(spark, base, "orders")
    sinks.save_snapshot(orders.where(done), base, "gone", key)
    sinks.delete_snapshot(spark, base, "gone")
    profile = sinks.load_profile(spark, base, "orders").where("column = 'o_custkey'").first()
    return sinks.load_snapshot(spark, base, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", r4(F.col("o_totalprice")).alias("o_totalprice"), "o_orderpriority",
        F.lit(profile["unique_values"]).cast("long").alias("profile_customers"))
