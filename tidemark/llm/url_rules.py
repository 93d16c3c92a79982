"""URL filters by a sort-merge range join of pages and rules.

A host's labels are reversed, so a rule's host and all its subdomains are one interval of keys. Pages and rules are
swept in the order of their keys; a stack keeps the rules whose intervals hold the present key, the nested ones on top.
Of the rules on the stack whose paths start the page's path, the longest wins.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_whole

_LABEL, _AFTER = "\x01", "\x02"


def lowered(text: Column) -> Column:
    """A-Z lower-cased, and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; '' without one."""
    return F.coalesce(lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; '' without a ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """The labels of a host, last first, each closed by a mark below all characters of hosts."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), _LABEL), F.lit(_LABEL))


class Sweep:
    """The stack of open rule hosts at a point of the sweep. Keys have to come in order, rules before pages of a key."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, dict[str, tuple], list[int]]] = []

    def _reach(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, host: str, path: str, verdict: str) -> None:
        self._reach(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}, []))
        _, paths, sizes = self.stack[-1]
        if path not in paths or verdict == "block":  # of equal rules a block holds
            paths[path] = (len(host) + len(path), len(host), host + path, verdict)
        if len(path) not in sizes:
            sizes.append(len(path))

    def judge(self, key: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits; of equally long ones, that of the longest host."""
        self._reach(key)
        fits = [r for _, paths, sizes in self.stack for n in sizes if n <= len(path) and (r := paths.get(path[:n]))]
        return max(fits)[2:] if fits else None


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) for each page. ``rules``: (host, path, verdict), verdict allow or block.

    Without a rule that fits, ``rule`` is null and the verdict is ``default``. A null url, or one without ://, has an
    empty host and path and fits no rule. Of rules that fit the longest, host and path together, wins; of equally long
    ones that of the longer host; of equal rules a block holds. Hosts of rules are lower-cased in A-Z like those of
    pages, and rules with a null host or path are left out. Pages that repeat stay and are judged alike, null ids pass
    unchanged, and an empty table gives an empty table.

    Rules and pages are dealt out by ranges of keys: a rule goes to each range that its interval meets, a page to its
    own, or, where one frequent key holds several ranges, to any of those. Each range is swept as it streams in.
    """
    url = F.col(url_col)
    pages = pages.select(F.col(id_col).alias("id"), url_host(url).alias("host"), url_path(url).alias("path"))
    pages = pages.withColumn("key", host_key(F.col("host")))
    rules = rules.where("host is not null and path is not null").select(lowered(F.col("host")).alias("host"), "path", "verdict")
    rules = rules.withColumn("key", host_key(F.col("host")))

    parts = max(2, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sample = [r.key for r in pages.select("key").orderBy(F.xxhash64("id", "path"), "key").limit(20 * parts).collect()]  # bounded by parts
    splits = sorted(sample)[20::20]

    @F.pandas_udf("array<int>")
    def ranges(lo: pd.Series, hi: pd.Series) -> pd.Series:
        return pd.Series([[bisect_left(splits, a), bisect_right(splits, b)] for a, b in zip(lo, hi)])

    pages = pages.withColumn("r", ranges("key", "key")).withColumn("range", (F.col("r")[0] + F.pmod(F.xxhash64("id", "path"), F.col("r")[1] - F.col("r")[0] + 1)).cast("int"))
    upper = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit(_AFTER))
    rules = rules.withColumn("r", ranges("key", upper)).withColumn("range", F.explode(F.sequence(F.col("r")[0], F.col("r")[1])))
    kind = pages.schema["id"].dataType.simpleString()
    both = pages.select("range", "key", F.lit(1).alias("page"), "id", "host", "path", F.lit(None).cast("string").alias("verdict")).unionByName(
        rules.select("range", "key", F.lit(0).alias("page"), F.lit(None).cast(kind).alias("id"), "host", "path", "verdict")
    )
    both = both.repartition(parts, "range").sortWithinPartitions("range", "key", "page")

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, last = Sweep(), None
        for frame in frames:
            found = []
            for at, key, page, host, path, verdict in zip(frame["range"], frame["key"], frame["page"], frame["host"], frame["path"], frame["verdict"]):
                if at != last:
                    state, last = Sweep(), at
                if page:
                    found.append(state.judge(key, path) or (None, default))
                else:
                    state.open(key, host, path, verdict)
            made = frame.loc[frame["page"] == 1, ["id", "host", "path"]]
            yield made.assign(rule=pd.Series([r for r, _ in found], dtype=object, index=made.index), verdict=pd.Series([v for _, v in found], dtype=object, index=made.index))

    return map_whole(both, stream, "host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
