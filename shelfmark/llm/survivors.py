"""The record that stands for each group of duplicates."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.runtime import Written, shuffle_partitions
from shelfmark.tables import current_files

TOKEN = re.compile(r"[^\W_]+|\s+|[^\w\s]|_")
#: Distinct values that one alignment takes; larger groups are aligned in chunks whose profiles are aligned again.
CHUNK = 64
#: Scores of a gap, and of two columns without a common token.
GAP, DIFFERENT = 0.4, -0.5

Profile = list[dict[str, float]]


def tokens_of(value: str) -> list[str]:
    return TOKEN.findall(value)


def align(profile: Profile, other: Profile) -> list[tuple[int | None, int | None]]:
    """Global alignment of two profiles: pairs of column numbers, None for a gap. Columns score by the share of tokens they agree on."""
    mass_a, mass_b = [sum(c.values()) or 1.0 for c in profile], [sum(c.values()) or 1.0 for c in other]
    holders: dict[str, list[int]] = {}
    for j, b in enumerate(other):
        for t in b:
            holders.setdefault(t, []).append(j)
    agree = [[DIFFERENT] * len(other) for _ in profile]
    for i, a in enumerate(profile):
        for j in {j for t in a.keys() & holders.keys() for j in holders[t]}:
            b = other[j]
            small, large = (a, b) if len(a) < len(b) else (b, a)
            share = sum(w * large[t] for t, w in small.items() if t in large) / (mass_a[i] * mass_b[j])
            agree[i][j] = 2 * share + DIFFERENT
    return best_path(agree, len(other))


def best_path(agree: list[list[float]], m: int) -> list[tuple[int | None, int | None]]:
    """The global alignment of greatest score: agree has a row per column of one side, with m scores each."""
    n = len(agree)
    best = [[-GAP * j for j in range(m + 1)]]
    for i, row in enumerate(agree, 1):
        up, left = best[-1], -GAP * i
        now = [left]
        for j in range(m):
            score, above, left = up[j] + row[j], up[j + 1] - GAP, left - GAP
            left = max(score, above, left)
            now.append(left)
        best.append(now)
    path: list[tuple[int | None, int | None]] = []
    i, j = n, m
    while i or j:
        if i and j and best[i][j] == best[i - 1][j - 1] + agree[i - 1][j - 1]:
            i, j = i - 1, j - 1
            path.append((i, j))
        elif i and (not j or best[i][j] == best[i - 1][j] - GAP):
            i -= 1
            path.append((i, None))
        else:
            j -= 1
            path.append((None, j))
    return path[::-1]


def merge(profile: Profile, other: Profile) -> Profile:
    """Both profiles as one. A column keeps every token of the two: one left out would be missing where values are aligned to it."""
    out = []
    for i, j in align(profile, other):
        column = dict(profile[i]) if i is not None else {}
        for t, w in (other[j] if j is not None else {}).items():
            column[t] = column.get(t, 0.0) + w
        out.append(column)
    return out


def progressive(profiles: list[Profile]) -> Profile:
    """Profiles aligned one after the other, the heaviest first."""
    order = sorted(profiles, key=lambda p: (-max((sum(c.values()) for c in p), default=0.0), len(p), repr(p)))
    out = order[0]
    for p in order[1:]:
        out = merge(out, p)
    return out


def token_distance(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def vote(weights: dict[str, float], guide: Profile) -> list[str]:
    """What each column of the guide says: the heaviest token of all values aligned to it, of equals the smaller; empty for a gap."""
    votes: list[dict[str, float]] = [{} for _ in guide]
    shares = [{t: 2 * (w / (sum(c.values()) or 1.0)) + DIFFERENT for t, w in c.items()} for c in guide]
    for value, w in weights.items():
        own = tokens_of(value)
        agree = [[c.get(t, DIFFERENT) for t in own] for c in shares]
        for i, j in best_path(agree, len(own)):
            if i is not None:
                t = own[j] if j is not None else ""
                votes[i][t] = votes[i].get(t, 0.0) + w
    return [min(c, key=lambda t: (-c[t], t)) for c in votes]


def settle(weights: dict[str, float]) -> tuple[str, str]:
    """(consensus, value) of one small group, values with their weights."""
    guide = progressive([[{t: w + 1e-9} for t in tokens_of(v)] for v, w in weights.items()])
    said = "".join(vote(weights, guide))
    if said in weights:
        return said, said
    own = tokens_of(said)
    return said, min(weights, key=lambda v: (token_distance(tokens_of(v), own), -weights[v], v))


_PROFILE = "group_id bigint, chunk bigint, profile array<map<string,double>>"


def consensus_values(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(group_id, consensus, value): for each group the existing value closest to the token-level consensus of all its values.

    rows: group_id, value, weight (how much the value's word counts; null or negative counts 0).
    Values are cut into tokens; within chunks of a group they are aligned progressively into a
    profile, the profiles of its chunks likewise, level by level, to one guide per group. Every
    value is then aligned to the guide on its own, and each column's weighted votes, gaps among
    them, are counted over all rows: the winner is the heaviest, of equals the smaller token. The
    emitted value is the one with the fewest token edits to that consensus, then the heavier, then
    the smaller. Null groups and null values take no part; a group of nulls only has no row; the
    empty value is a value without tokens. Columns vote on their own, so the consensus may be a
    string that no value has; the emitted value always is one. Groups of at most `chunk` distinct
    values are settled where they are, with the same result (settle()). A larger group's values are never gathered in one task: chunks
    hold at most about `chunk` distinct values, and votes are sums. What its last merge does gather
    are the guide's columns with all their distinct tokens. A value meets only those guide entries
    that its own tokens name, by a join on group and token, not the guide as a whole.
    """
    values = Written(
        rows.where(F.col("group_id").isNotNull() & F.col("value").isNotNull()).groupBy(F.col("group_id").cast("bigint").alias("group_id"), "value").agg(F.sum(F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))).alias("weight")).withColumn("value_no", F.monotonically_increasing_id()),
        "values",
    ).df

    sizes = Written(values.groupBy("group_id").agg(F.count("*").alias("n")), "sizes").df

    def small(frames):  # noqa: ANN001, ANN202
        group, weights = None, {}
        for pdf in frames:
            out = []
            for g, v, w in zip(pdf["group_id"], pdf["value"], pdf["weight"]):
                if g != group:
                    if weights:
                        out.append((group, *settle(weights)))
                    group, weights = g, {}
                weights[v] = w
            yield pd.DataFrame(out, columns=["group_id", "consensus", "value"])
        if weights:
            yield pd.DataFrame([(group, *settle(weights))], columns=["group_id", "consensus", "value"])

    one_chunk = values.join(sizes.where(F.col("n") <= chunk), "group_id").select("group_id", "value", "weight")
    settled = one_chunk.repartition(shuffle_partitions(rows.sparkSession), "group_id").sortWithinPartitions("group_id").mapInPandas(small, "group_id bigint, consensus string, value string")
    if sizes.where(F.col("n") > chunk).head() is None:
        return settled
    values = values.join(sizes.where(F.col("n") > chunk).select("group_id"), "group_id", "left_semi")
    placed = values.join(sizes, "group_id").withColumn("chunk", F.pmod(F.xxhash64("value"), F.ceil(F.col("n") / chunk)))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        profiles = [[{t: w + 1e-9} for t in tokens_of(v)] for v, w in zip(pdf["value"], pdf["weight"])]
        return pd.DataFrame({"group_id": [pdf["group_id"].iloc[0]], "chunk": [pdf["chunk"].iloc[0]], "profile": [progressive(profiles)]})

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        profiles = [[dict(c) for c in p] for p in pdf["profile"]]
        return pd.DataFrame({"group_id": [pdf["group_id"].iloc[0]], "chunk": [pdf["chunk"].iloc[0] // chunk], "profile": [progressive(profiles)]})

    pending = Written(placed.groupBy("group_id", "chunk").applyInPandas(first, _PROFILE), "profiles")
    merged = [pending.df]
    while pending.df.where("chunk > 0").head() is not None:
        # groups of one chunk are through; only the others go up a level
        several = pending.df.where("chunk > 0").select("group_id").distinct()
        merged[-1] = pending.df.join(several, "group_id", "left_anti")
        up = pending.df.join(several, "group_id", "left_semi").withColumn("up", F.floor(F.col("chunk") / chunk))
        pending = Written(up.groupBy("group_id", "up").applyInPandas(lambda p: again(p), _PROFILE), "profiles")
        merged.append(pending.df)
    guide = Written(reduce(DataFrame.unionByName, merged).select("group_id", "profile"), "guides").df

    def entries(frames):  # noqa: ANN001, ANN202
        for pdf in frames:
            out: dict[tuple[int, str], tuple[list[int], list[float]]] = {}
            for g, p in zip(pdf["group_id"], pdf["profile"]):
                for i, column in enumerate(map(dict, p)):
                    mass = sum(column.values()) or 1.0
                    for t, w in column.items():
                        places, scores = out.setdefault((g, t), ([], []))
                        places.append(i)
                        scores.append(2 * (w / mass) + DIFFERENT)
            yield pd.DataFrame([(g, t, *x) for (g, t), x in out.items()], columns=["group_id", "token", "places", "scores"])

    def named(frames):  # noqa: ANN001, ANN202
        for pdf in frames:
            yield pd.DataFrame([(g, k, t) for g, k, v in zip(pdf["group_id"], pdf["value_no"], pdf["value"]) for t in dict.fromkeys(tokens_of(v))], columns=["group_id", "value_no", "token"])

    def votes_of(frames):  # noqa: ANN001, ANN202
        for pdf in frames:
            out = []
            for g, v, w, width, hits in zip(pdf["group_id"], pdf["value"], pdf["weight"], pdf["width"], pdf["hits"]):
                own = tokens_of(v)
                agree = [[DIFFERENT] * len(own) for _ in range(width)]
                at: dict[str, list[int]] = {}
                for j, t in enumerate(own):
                    at.setdefault(t, []).append(j)
                for hit in hits if hits is not None else ():
                    for i, score in zip(hit["places"], hit["scores"]):
                        for j in at[hit["token"]]:
                            agree[i][j] = float(score)
                out += [(g, i, own[j] if j is not None else "", w) for i, j in best_path(agree, len(own)) if i is not None]
            yield pd.DataFrame(out, columns=["group_id", "place", "token", "weight"])

    side = guide.select("group_id", "profile").mapInPandas(entries, "group_id bigint, token string, places array<int>, scores array<double>")
    tokens = values.select("group_id", "value_no", "value").mapInPandas(named, "group_id bigint, value_no bigint, token string")
    hits = tokens.join(side, ["group_id", "token"]).groupBy("value_no").agg(F.collect_list(F.struct("token", "places", "scores")).alias("hits"))
    joined = values.join(hits, "value_no", "left").join(guide.select("group_id", F.size("profile").alias("width")), "group_id").select("group_id", "value", "weight", "width", "hits")
    votes = joined.mapInPandas(votes_of, "group_id bigint, place int, token string, weight double").groupBy("group_id", "place", "token").agg(F.sum("weight").alias("weight"))
    winner = votes.groupBy("group_id", "place").agg(F.min(F.struct((-F.col("weight")).alias("w"), "token")).alias("best"))
    # a place per column of the guide, so the list is as long as the group's longest value
    said = winner.groupBy("group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col("best.token").alias("token")))), lambda x: x["token"]), "").alias("consensus"))
    said = guide.select("group_id").distinct().join(said, "group_id", "left").select("group_id", F.coalesce("consensus", F.lit("")).alias("consensus"))

    def edits(frames):  # noqa: ANN001, ANN202
        for pdf in frames:
            yield pdf.assign(d=[token_distance(tokens_of(v), tokens_of(c)) for v, c in zip(pdf["value"], pdf["consensus"])])

    near = values.drop("value_no").join(said, "group_id").mapInPandas(edits, "group_id bigint, value string, weight double, consensus string, d int")
    best = near.groupBy("group_id", "consensus").agg(F.min(F.struct("d", (-F.col("weight")).alias("w"), "value")).alias("best"))
    return settled.unionByName(best.select("group_id", "consensus", F.col("best.value").alias("value")))


def exact_candidates(dup_groups: DataFrame, dup_members: DataFrame, files: DataFrame) -> DataFrame:
    """group_id, file_id, pid, path, mtime: the current rows of the members of every recorded exact group, distinct."""
    exact = dup_groups.where(F.lower(F.regexp_replace("kind", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")) == "exact").where(F.col("id").isNotNull()).select(F.col("id").alias("group_id")).distinct()
    members = dup_members.where(F.col("group_id").isNotNull() & F.col("file_id").isNotNull()).select("group_id", "file_id").distinct().join(exact, "group_id", "left_semi")
    return members.join(current_files(files, ["pid", "path", "mtime"]).withColumnRenamed("id", "file_id"), "file_id")


def consensus_records(records: DataFrame, trust: dict[str, Column]) -> DataFrame:
    """(group_id, consensus, record): of each group the existing record closest to the consensus of its fields.

    records: group_id and any columns. trust: for each field, most important first, how much its
    value's word counts; null counts least. A record is a sequence of one token per field, and each
    token names its field, so aligning records progressively puts every field in a column of its own
    whatever their order. A column's winner is its most trusted token, which no number of less trusted
    ones outvotes: consensus holds the winners' trusts, field by field, and may come from several
    records. The emitted record is the one closest to it, compared column by column in the order of
    the fields; of records as close in all of them the one of the greatest columns. Null groups have
    no row. Votes and distances are maxima per task before anything is shuffled, so a group of any
    size is one row per task.
    """
    fields = [c.alias(f) for f, c in trust.items()]
    columns = [c for c in records.columns if c != "group_id"]
    tokens = records.where(F.col("group_id").isNotNull()).select("group_id", *fields, F.struct(*columns).alias("_record"))
    # one vote for all columns at once, and with it the record that comes nearest to them all
    voted = tokens.groupBy("group_id").agg(F.struct(*(F.max(f).alias(f) for f in trust)).alias("consensus"), F.max(F.struct(*trust, "_record")).alias("_closest"))
    return voted.select("group_id", "consensus", F.col("_closest._record").alias("record"))


def keeper_trust() -> dict[str, Column]:
    """The reference's preference, field by field: a pid rather than none, the shorter path in bytes, the smaller mtime as stored, the smaller id."""
    return {"has_pid": F.col("pid").isNotNull(), "short_path": -F.octet_length("path").cast("bigint"), "early": -F.col("mtime"), "low_id": -F.col("file_id")}


def disputed_keepers(dup_groups: DataFrame, dup_members: DataFrame, files: DataFrame) -> DataFrame:
    """(group_id, file_id, pid, path, mtime) of the best candidate of exact groups whose recorded keeper is null or another.

    Groups without a candidate that exists in files have no row.
    """
    best = consensus_records(exact_candidates(dup_groups, dup_members, files), keeper_trust()).select("group_id", "record.file_id", "record.pid", "record.path", "record.mtime")
    kept = dup_groups.select(F.col("id").alias("group_id"), "keep_file_id").distinct()
    return best.join(kept, "group_id").where(F.col("keep_file_id").isNull() | (F.col("keep_file_id") != F.col("file_id"))).select("group_id", "file_id", "pid", "path", "mtime").distinct()


def consensus_paths(dup_groups: DataFrame, dup_members: DataFrame, files: DataFrame) -> DataFrame:
    """(group_id, consensus, path) of every exact group; a member with a pid votes twice."""
    members = exact_candidates(dup_groups, dup_members, files)
    return consensus_values(members.select("group_id", F.col("path").alias("value"), F.when(F.col("pid").isNull(), 1).otherwise(2).alias("weight"))).withColumnRenamed("value", "path")
