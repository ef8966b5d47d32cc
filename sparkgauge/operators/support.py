"""How far a work item's profile is from those of other repositories, by structure and by features.

A profile is a category, a size, a complexity, a set of ecosystems and a list of features, each available
with a bucket or not.  Profiles held by several repositories have distance 0 and are met by a join.
Only the rest is searched: first among profiles of its category and size, and wider only where a nearer
one may lie outside, which the least distance of another size or category tells.  So the answer is that of
all pairs, while few pairs are formed; they are met in blocks of bounded size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import _cut

#: Largest distance of two sizes and of two complexities, and the unit that distances are rounded to.
SIZES, COMPLEXITIES, UNIT = 8, 3, 1_000_000
PROFILE = ("category", "size", "complexity", "ecosystems", "features")
FEATURE = "array<struct<availability:string,bucket:int,most:int>>"
AVAILABLE = "available"


def _holders(observations: DataFrame) -> DataFrame:
    """One row a repository and profile: its signature, how many observations, and the first of them."""
    rows = observations.select("repo", "record", "item", "category", F.col("size").cast("int").alias("size"), F.col("complexity").cast("int").alias("complexity"), F.array_sort(F.array_distinct("ecosystems")).alias("ecosystems"), F.col("features").cast(FEATURE).alias("features"))
    signature = F.to_json(F.struct(*PROFILE), {"ignoreNullFields": "false"})
    return rows.withColumn("signature", signature).groupBy("repo", "signature", *PROFILE).agg(F.count("*").alias("n"), F.min(F.struct("record", "item")).alias("first"))


def _met(asks: DataFrame, offers: DataFrame, band: list[str], block: int) -> DataFrame:
    """The best offer of another repository for each ask of the same band: signature, best (score, holder, structural, feature, signature)."""
    import numpy as np
    import pandas as pd

    key = F.to_json(F.struct(*[F.col(c) for c in band]), {"ignoreNullFields": "false"}) if band else F.lit("all")
    asks, offers = asks.withColumn("_band", key), offers.withColumn("_band", key)
    many = lambda df, n: df.groupBy("_band").agg(F.ceil(F.count("*") / block).cast("int").alias(n))
    blocks = many(asks, "_asks").join(many(offers, "_offers"), "_band")
    deal = lambda df, own, other, x, y: df.join(blocks, "_band").withColumns({x: F.pmod(F.xxhash64("signature"), F.col(own)).cast("int"), y: F.explode(F.sequence(F.lit(0), F.col(other) - 1))}).drop("_asks", "_offers")
    left, right = deal(asks, "_asks", "_offers", "_x", "_y"), deal(offers, "_offers", "_asks", "_y", "_x")
    right = right.select(*[F.col(c).alias(f"o{c}") for c in right.columns])
    types = {f.name: f.dataType.simpleString() for f in offers.schema}
    schema = f"signature string, score long, repo {types['repo']}, record {types['record']}, item {types['item']}, structural long, feature long, found string"

    def whole(x):  # in UNITs, halves away from zero
        return np.floor(x * UNIT + 0.5 + 1e-6).astype(np.int64)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({n.split()[0]: [] for n in schema.split(", ")})
        b = b.rename(columns=lambda c: c[1:]).sort_values(["repo", "record", "item"], kind="stable").reset_index(drop=True)
        kinds = {v: i for i, v in enumerate(pd.unique(pd.concat([a["category"], b["category"]])))}
        code = lambda c: c.map(kinds).to_numpy()
        ecosystems = {v: i for i, v in enumerate({e for s in (a["ecosystems"], b["ecosystems"]) for x in s for e in x})}

        def incidence(sets):
            m = np.zeros((len(sets), max(1, len(ecosystems))), np.float32)
            for i, s in enumerate(sets):
                m[i, [ecosystems[e] for e in s]] = 1
            return m

        left, right = incidence(a["ecosystems"]), incidence(b["ecosystems"])
        both = (left @ right.T).astype(np.float64)
        union = left.sum(1)[:, None] + right.sum(1)[None] - both
        far = lambda c: abs(a[c].to_numpy(np.int64)[:, None] - b[c].to_numpy(np.int64)[None])
        total = (code(a["category"])[:, None] != code(b["category"])[None]) + far("size") / SIZES + far("complexity") / COMPLEXITIES
        structural = whole((total + np.where(union == 0, 0, 1 - both / np.where(union == 0, 1, union))) / 4)
        count = len(a["features"].iloc[0])
        total = np.zeros(structural.shape)
        for k in range(count):
            x, y = ([f[k] for f in df["features"]] for df in (a, b))
            states = {v: i for i, v in enumerate({f["availability"] for f in [*x, *y]})}
            p, q = (np.array([states[f["availability"]] for f in s]) for s in (x, y))
            u, v = (np.array([f["bucket"] or 0 for f in s], float) for s in (x, y))
            most = np.array([f["most"] or 1 for f in x], float)
            same = p[:, None] == q[None]
            total += np.where(~same, 1, np.where((p == states.get(AVAILABLE, -1))[:, None], abs(u[:, None] - v[None]) / most[:, None], 0))
        feature = whole(total / max(1, count))
        score = whole((4 * structural + count * feature) / (4 + count) / UNIT)
        score[a["repo"].to_numpy()[:, None] == b["repo"].to_numpy()[None]] = np.iinfo(np.int64).max
        at = score.argmin(1)  # the first of equal ones
        rows = np.arange(len(a))
        got = b.iloc[at].reset_index(drop=True)
        out = pd.DataFrame({"signature": a["signature"].to_numpy(), "score": score[rows, at], "repo": got["repo"], "record": got["record"], "item": got["item"], "structural": structural[rows, at], "feature": feature[rows, at], "found": got["signature"]})
        return out[out["score"] < np.iinfo(np.int64).max]

    pairs = left.groupBy("_band", "_x", "_y").cogroup(right.groupBy("o_band", "o_x", "o_y")).applyInPandas(best, schema)
    return pairs.groupBy("signature").agg(F.min(F.struct("score", "repo", "record", "item", "structural", "feature", "found")).alias("best"))


def support_distance(observations: DataFrame, block: int = 1_024) -> DataFrame:
    """Distance of each repository's profiles to the nearest of another repository.

    observations: repo, record, item, category, size (0 to 8), complexity (0 to 3), ecosystems (array), features (array of
    availability, bucket, most; all of one length).  Sizes, complexities, ecosystems and features are not null.  Gives repo, profile
    (signature), observations, score, structural and feature distance, exact_observations and exact_repositories (of the
    same profile elsewhere), the nearest's repo, record and item, and observations and repositories of its profile elsewhere.
    Ties go to the smallest repo, record and item.  Without another repository the distances are null.
    """
    holders = _cut(_holders(observations))
    profiles = holders.groupBy("signature").agg(F.count("*").alias("_repos"), F.sum("n").alias("_n"), F.min(F.struct("repo", "first")).alias("_one"))
    second = holders.join(profiles.where("_repos > 1").select("signature", "_one"), "signature").where(F.col("repo") != F.col("_one.repo")).groupBy("signature").agg(F.min(F.struct("repo", "first")).alias("_two"))
    own = holders.join(profiles, "signature").join(second, "signature", "left")

    # The first two repositories of a profile are enough, whichever repository asks.
    one = holders.join(profiles.select("signature", F.col("_one.repo").alias("repo")), ["signature", "repo"])
    two = holders.join(second.select("signature", F.col("_two.repo").alias("repo")), ["signature", "repo"])
    offers = _cut(one.unionByName(two).select("signature", "repo", F.col("first.record").alias("record"), F.col("first.item").alias("item"), *PROFILE))
    asks = holders.join(profiles.where("_repos = 1").select("signature"), "signature", "left_semi").select("signature", "repo", *PROFILE)
    found = None
    for band, outside in ((["category", "size"], 1 / SIZES), (["category"], 1.0), ([], None)):
        got = _cut(_met(asks, offers, band, block))
        if outside is not None:  # what lies outside is at least so far; a rounding each of three
            least = F.floor(F.lit(outside * UNIT) / (4 + F.size("features"))) - 3
            sure = got.join(asks.select("signature", "features"), "signature").where(F.col("best.score") < least).select("signature", "best")
            asks = asks.join(sure, "signature", "left_anti")
        else:
            sure = got
        found = sure if found is None else found.unionByName(sure)
    near = found.select("signature", F.col("best").alias("_near"))
    there = profiles.select(F.col("signature").alias("_found"), F.col("_n").alias("_fn"), F.col("_repos").alias("_fr"))
    exact = F.when(F.col("_one.repo") != F.col("repo"), F.col("_one")).otherwise(F.col("_two"))
    rows = own.join(near, "signature", "left").withColumns({"_exact": exact, "_same": F.col("_repos") > 1})
    rows = rows.withColumn("_found", F.when(F.col("_same"), F.col("signature")).otherwise(F.col("_near.found"))).join(there, "_found", "left")
    # A profile met in its own repository too does not count that one.
    mine = holders.select(F.col("signature").alias("_found"), "repo", F.col("n").alias("_mine"))
    rows = rows.join(mine, ["_found", "repo"], "left")
    share = lambda c: F.when(F.col("_same"), F.lit(0.0)).otherwise(F.col(f"_near.{c}") / UNIT)
    pick = lambda a, b: F.when(F.col("_same"), F.col(a)).otherwise(F.col(b))
    return rows.select(
        "repo", F.col("signature").alias("profile"), F.col("n").alias("observations"),
        share("score").alias("score"), share("structural").alias("structural_distance"), share("feature").alias("feature_distance"),
        F.when(F.col("_same"), F.col("_n") - F.col("n")).otherwise(0).alias("exact_observations"), F.when(F.col("_same"), F.col("_repos") - 1).otherwise(0).alias("exact_repositories"),
        pick("_exact.repo", "_near.repo").alias("nearest_repo"), pick("_exact.first.record", "_near.record").alias("nearest_record"), pick("_exact.first.item", "_near.item").alias("nearest_item"),
        (F.col("_fn") - F.coalesce("_mine", F.lit(0))).alias("nearest_observations"), (F.col("_fr") - F.when(F.col("_mine").isNull(), 0).otherwise(1)).alias("nearest_repositories"),
    )
