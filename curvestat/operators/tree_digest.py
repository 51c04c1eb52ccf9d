"""Digest of ordered data as a tree, so that no task holds the digests of all rows.

Rows have whole-number keys, outermost first, and a leaf digest. From the innermost key on,
rows whose keys agree but for the last, and whose last key has the same quotient by the fan-out, are
brought together: their digests, in order and each behind its key, make one. This is repeated
with the quotients until one digest is left for the key above. So a row of a group of
at most FAN digests is the most that a task holds at once, whatever the number of rows (unless a caller
sets ``deepest``), and partial results never grow. An altered, a moved, a missing and a further row each change the
digests on their way to the root, and comparing two trees level by level finds where.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN = 64


def scaled_text(values: Column, digits: int = 6) -> Column:
    """A curve as text of whole multiples of 10^-digits, which any SQL engine writes alike."""
    return F.array_join(F.transform(values, lambda v: F.round(v.cast("double") * 10**digits).cast("bigint").cast("string")), ",")


def leaf(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _together(rows: DataFrame, keep: list[str], key: str, into: Column) -> DataFrame:
    """One digest for each combination of keep and into (which takes the place of key)."""
    parts = F.sort_array(F.collect_list(F.struct(key, "digest")))
    lines = F.array_join(F.transform(parts, lambda x: F.concat(x[key].cast("string"), F.lit(":"), x["digest"])), ";")
    grouped = rows.groupBy(*keep, into.alias("into")).agg(leaf(lines).alias("digest"), F.sum("rows").alias("rows"))
    return grouped.withColumnRenamed("into", key)


def levels(most: int, fan: int = FAN) -> int:
    """How often a key from 0 to most is divided until one quotient is left."""
    n = 1
    while most >= fan:
        most, n = most // fan, n + 1
    return n


def tree(rows: DataFrame, group: list[str], keys: list[str], digest: str = "digest", fan: int = FAN, deepest: dict[str, int] | None = None) -> list[DataFrame]:
    """All levels above the leaves, from the lowest to the roots (group, digest, rows).

    rows: group, keys (whole numbers from 0, together unique) and the leaf digest. deepest: for
    some keys, the most divisions; the last of them brings all quotients that are left together, in order, so the
    digest is of all rows, and a task holds as many digests as there are quotients.
    """
    if fan < 2:
        raise ValueError("the fan-out is at least 2")
    if any(n < 1 for n in (deepest or {}).values()):
        raise ValueError("a key is divided at least once")
    most = rows.agg(*[F.max(k).alias(k) for k in keys], *[F.min(k).alias(f"least_{k}") for k in keys]).first()
    if any((most[f"least_{k}"] or 0) < 0 for k in keys):
        raise ValueError("keys count from 0")
    out = [rows.select(*group, *[F.col(k).cast("bigint").alias(k) for k in keys], F.col(digest).alias("digest"), F.lit(1).cast("bigint").alias("rows"))]
    for i in reversed(range(len(keys))):
        key, keep = keys[i], [*group, *keys[:i]]
        n = levels(most[key] or 0, fan)
        last = min(n, (deepest or {}).get(key, n)) - 1
        for _ in range(last):
            out.append(_together(out[-1], keep, key, F.floor(F.col(key) / fan)))
        out.append(_together(out[-1], keep, key, F.lit(0).cast("bigint")))
        out[-1] = out[-1].drop(key)
    return out[1:]


def root(rows: DataFrame, group: list[str], keys: list[str], digest: str = "digest", fan: int = FAN, deepest: dict[str, int] | None = None) -> DataFrame:
    """group, digest and rows of each root; repeated keys are an error of the caller that CHK3 finds."""
    return tree(rows, group, keys, digest, fan, deepest)[-1]


def changed(one: DataFrame, other: DataFrame, group: list[str], keys: list[str], fan: int = FAN) -> DataFrame:
    """Keys of the leaves that differ between two tables, looked for below differing roots only."""
    same_root = root(one, group, keys, fan=fan).join(root(other, group, keys, fan=fan), [*group, "digest"]).select(*group)
    side = lambda df, name: df.select(*group, *keys, F.col("digest").alias(name))
    left, right = (df.join(same_root, group, "left_anti") for df in (side(one, "digest_one"), side(other, "digest_other")))
    both = left.join(right, [*group, *keys], "full_outer").filter(~F.col("digest_one").eqNullSafe(F.col("digest_other")))
    problem = F.when(F.col("digest_one").isNull(), "missing").when(F.col("digest_other").isNull(), "further").otherwise("altered")
    return both.select(*group, *keys, problem.alias("problem"))
