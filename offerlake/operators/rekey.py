"""Keys derived anew from urls, with rows that meet on a key merged along whole chains.

Each row points to the owner of its new key: the row that has had that key all along, else the row
of the smallest id among those that get it. Owners may move on themselves, so pointers form chains
a -> b -> c and, where rows have exchanged keys, cycles. Pointers are doubled until nothing changes,
about log2 of the longest chain times, over the rows that point elsewhere only; each round is a
stored table.

A chain ends in a row that owns its own new key. In a cycle nobody does: the row of the largest id
stays, which is the one that a scan by id reaches last, when the others have been merged already.
Either way every key has one row in the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from offerlake.functions import scalars
from offerlake.sources.scratch import dropped, stored

#: Rounds of pointer doubling: chains of up to 2 ** ROUNDS rows; more is an error.
ROUNDS = 48


def url_key(url: Column, old: Column) -> Column:
    """The key that a product's url gives; the old one where there is no url."""
    return F.when(F.coalesce(url, F.lit("")) == "", old).otherwise(scalars.slug(url, F.lit("")))


def pointers(keyed: DataFrame) -> DataFrame:
    """(id, to): the owner of each row's new key; keyed is (id, sid, old, new), old keys being unique in their shop. Rows of a null key own it themselves."""
    had = keyed.select("sid", F.col("old").alias("new"), F.col("id").alias("had"))
    least = keyed.filter("new is not null").groupBy("sid", "new").agg(F.min("id").alias("least"))
    owner = least.join(had, ["sid", "new"], "left").select("sid", "new", F.coalesce("had", "least").alias("to"))
    return keyed.join(owner, ["sid", "new"], "left").select("id", F.coalesce("to", "id").alias("to"))


def _doubled(moves: DataFrame, value: str) -> DataFrame:
    """moves (id, to, value) with every pointer taken as far again, and the largest value met on the way."""
    on = moves.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col(value).alias("more"))
    return moves.join(on, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.greatest(value, "more").alias(value), (F.coalesce(F.col("more"), F.col(value)) > F.col(value)).alias("grew"), F.col("next").isNotNull().alias("went"))


def _until_still(moves: DataFrame, changed: Column, name: str) -> DataFrame:
    for _ in range(ROUNDS):
        after = stored(_doubled(moves.select("id", "to", "top"), "top"), name)
        dropped(moves)
        moves = after
        if moves.filter(changed).isEmpty():
            return moves
    raise ValueError(f"a chain of keys is longer than 2 ** {ROUNDS} rows")


def roots(points: DataFrame) -> DataFrame:
    """(id, master): where each chain of pointers (id, to) ends; rows that point to themselves are left out."""
    points = stored(points, "key-owners")
    moved = points.filter("id <> to").withColumn("top", F.greatest("id", "to"))
    # The largest id ahead of each row. Where it lies ahead of itself the row is in a cycle, and its end.
    ahead = _until_still(stored(moved, "chains"), F.col("grew"), "chains")
    tops = ahead.select(F.col("id").alias("to"), F.col("top").alias("ahead"))
    ends = points.filter("id <> to").join(tops, "to").filter("ahead = id").select("id")
    # Without the ends of cycles all that is left are chains.
    open_ = stored(points.filter("id <> to").join(ends, "id", "left_anti").withColumn("top", F.col("id")), "open-chains")
    dropped(points)
    dropped(ahead)
    return _until_still(open_, F.col("went"), "open-chains").select("id", F.col("to").alias("master"))


def rederive(products: DataFrame, new_pid: Column) -> DataFrame:
    """(id, pid, master): the new key of each row and the row that it is merged into, itself if it stays."""
    keyed = stored(products.select("id", "sid", F.col("pid").alias("old"), new_pid.alias("new")), "keys")
    ends = roots(pointers(keyed))
    return keyed.join(ends, "id", "left").select("id", F.col("new").alias("pid"), F.coalesce("master", "id").alias("master"))


def merged(products: DataFrame, dependants: dict[str, DataFrame], moves: DataFrame, unique: tuple[str, ...] = ("links",)) -> dict[str, DataFrame]:
    """products under their new keys and what hangs on them (product_id) on the rows that stay.

    moves is what rederive() gives. In the dependants named in unique, rows that become equal are one row.
    """
    stay = moves.filter("id = master").select("id", F.col("pid").alias("_pid"))
    gone = moves.filter("id <> master").select(F.col("id").alias("product_id"), "master")

    def follow(name: str, df: DataFrame) -> DataFrame:
        out = df.join(gone, "product_id", "left").withColumn("product_id", F.coalesce("master", "product_id")).select(*df.columns)
        return out.distinct() if name in unique else out

    rows = products.join(stay, "id").withColumn("pid", F.col("_pid")).select(*products.columns)
    return {"products": rows, **{name: follow(name, df) for name, df in dependants.items()}}
