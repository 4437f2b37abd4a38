"""Repair of the structure of conversations by a scan of min-plus matrices.

Rows (conv_id, turn, role, text) of a conversation, ordered by turn, should have roles that read ``(s?(ua)+)?`` by
their initials. ``flagged`` finds each row's first fault, ``plans`` the cheapest edits (``minplus``: every row is a
4x4 matrix over (cost, audit), multiplied as a tree), ``repaired`` applies them.

How it scales: the matrices need no texts. Equal rows of one turn are one row with a count before anything else is
shuffled; a role and text seen in an earlier turn is found by a joined aggregate, whose hot keys an adaptive join
splits. Rows are dealt by ranges of (conversation, turn), so a very long conversation lies in many partitions, each
of which multiplies its own part; the parts of a conversation are multiplied FAN at a time, in rounds. Texts are
shuffled once, to apply the edits: that pass reads a conversation's rows as a sorted stream and holds one batch. It is
one task a conversation, as one digest of its whole text is asked for.

Defined cases: null role and text count as one space, also where ``damaged`` makes its key of nulls; rows with null
conv_id form one conversation; null turns come first; rows of one turn go by role, then by the MD5 of the text, and
equal ones side by side; a conversation all of whose rows are gone has cost 0, an empty audit and no rows; very long
texts are read whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuegrid.llm import minplus
from cuegrid.llm.common import materialise, prepare
from cuegrid.llm.minplus import Matrices

INK = r"[^\x20\x09-\x0D]"
#: Turns that are multiplied at once in a task, and parts of a conversation that one task multiplies in a round.
BLOCK, FAN = 4096, 32
ROLE_OF = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted faults, by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1
    empties its text, 2 removes its . ! ?, 3 repeats it, 4 makes it the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _digested(rows: DataFrame) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), F.unhex(F.md5(space("text").cast("binary"))).alias("digest"))


def flagged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, n, blank, truncated, seen): each kind of row of a turn once with its number n.
    ``seen``: its role and text stand in an earlier turn as well; of the n rows, all but the first repeat it anyhow."""
    d = _digested(rows)
    blank = ~F.col("text").rlike(INK)
    truncated = ~F.regexp_extract("text", rf"({INK})[\x20\x09-\x0D]*\z", 1).isin(".", "!", "?")
    kinds = d.select("conv_id", "turn", "role", "digest", blank.alias("blank"), truncated.alias("truncated")).groupBy("conv_id", "turn", "role", "digest").agg(F.count(F.lit(1)).alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    kinds = materialise(kinds, "turn-kinds")
    at = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    several = kinds.where("NOT blank").groupBy("conv_id", "role", "digest").agg(F.min(at).alias("_first"), F.count(F.lit(1)).alias("_times")).where("_times > 1")
    several = several.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "_first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    seen = F.coalesce(at > F.col("_first"), F.lit(False))
    return kinds.join(several, same, "left").select(*kinds.columns, seen.alias("seen"))


def fault_counts(flags: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated) of ``flagged``: every row counts for its first fault."""
    kept = ~F.col("blank") & ~F.col("seen")
    blank = F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0))
    duplicate = F.sum(F.when(F.col("blank"), 0).when(F.col("seen"), F.col("n")).otherwise(F.col("n") - 1))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    return flags.groupBy("conv_id").agg(gaps.cast("long").alias("gaps"), blank.cast("long").alias("blank"), duplicate.cast("long").alias("duplicate"), F.sum((kept & F.col("truncated")).cast("long")).alias("truncated"))


PART = "conv_id string, part long, first int, last int, illegal long, costs array<long>, audits array<string>"
_LEGAL = np.zeros((4, 4), bool)
for _a, _b in ("su", "ua", "au"):
    _LEGAL[minplus.INITIALS.index(_a), minplus.INITIALS.index(_b)] = True


_PART_COLUMNS = ["conv_id", "part", "first", "last", "illegal", "costs", "audits"]


class _Runs:
    """What a task has of one conversation: products of blocks that double in size, so that none is joined often."""

    def __init__(self, conv):
        self.conv, self.stack, self.first, self.last, self.illegal = conv, [], None, None, 0

    def add(self, m: Matrices, first: int, last: int, illegal: int) -> None:
        if self.first is None:
            self.first = first
        else:
            illegal += not _LEGAL[self.last, first]
        self.last, self.illegal = last, self.illegal + illegal
        level = 0
        while self.stack and self.stack[-1][0] <= level:
            m, level = minplus.product(self.stack.pop()[1], m), level + 1
        self.stack.append((level, m))

    def row(self, part: int) -> tuple:
        m = self.stack.pop()[1]
        while self.stack:
            m = minplus.product(self.stack.pop()[1], m)
        return self.conv, part, self.first, self.last, self.illegal, m.cost.ravel().tolist(), [x.decode() for x in m.audit.ravel()]


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition's rows in order to one row for each conversation: the product of its turns there."""
    all_kinds, part, now, out = minplus.kinds(), TaskContext.get().partitionId(), None, []
    for pdf in batches:
        for conv, m, first, last, illegal in _blocks(pdf, all_kinds):
            if now is not None and now.conv != conv:
                out.append(now.row(part))
                now = None
            now = now or _Runs(conv)
            now.add(m, first, last, illegal)
        yield pd.DataFrame(out, columns=_PART_COLUMNS)
        out = []
    if now is not None:
        yield pd.DataFrame([now.row(part)], columns=_PART_COLUMNS)


def _blocks(pdf: pd.DataFrame, all_kinds: Matrices) -> Iterator[tuple]:
    """(conv_id, matrix, first and last initial, illegal pairs) of each conversation in blocks of turns."""
    n = pdf["n"].to_numpy(np.int64)
    ends, at = np.cumsum(n), 0
    total = int(ends[-1]) if len(n) else 0
    initial = pdf["initial"].to_numpy(np.int64)
    truncated, gone = pdf["truncated"].to_numpy(bool), pdf["gone"].to_numpy(bool)
    convs = pdf["conv_id"].tolist()
    fresh = pdf["conv_id"].ne(pdf["conv_id"].shift()) & ~(pdf["conv_id"].isna() & pdf["conv_id"].shift().isna())
    change = np.cumsum(fresh.to_numpy())
    while at < total:
        places = np.arange(at, min(at + BLOCK, total))
        row = np.searchsorted(ends, places, "right")
        again = places > ends[row] - n[row]  # all but the first of equal rows repeat it
        k = minplus.kind(initial[row], truncated[row], gone[row] | again)
        _, group = np.unique(change[row], return_inverse=True)
        made = minplus.reduced(all_kinds[k], group)
        bad = ~_LEGAL[initial[row[:-1]], initial[row[1:]]] & (group[:-1] == group[1:])
        illegal = np.bincount(group[1:][bad], minlength=len(made))
        begin = np.searchsorted(group, np.arange(len(made)))
        end = np.append(begin[1:], len(row)) - 1
        for g in range(len(made)):
            yield convs[row[begin[g]]], made[g : g + 1], int(initial[row[begin[g]]]), int(initial[row[end[g]]]), int(illegal[g])
        at = int(places[-1]) + 1


def _together(pdf: pd.DataFrame) -> pd.DataFrame:
    """The product of some neighbouring parts of one conversation."""
    run = _Runs(pdf["conv_id"].iloc[0])
    for r in pdf.sort_values("part").itertuples(index=False):
        run.add(Matrices(np.array(r.costs, np.int64).reshape(1, 4, 4), np.array([x.encode() for x in r.audits]).reshape(1, 4, 4)), r.first, r.last, r.illegal)
    return pd.DataFrame([run.row(int(pdf["part"].min()))], columns=_PART_COLUMNS)


def _planned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            audits = [[x.encode() for x in a] for a in pdf["audits"]]
            cost, audit = minplus.finish(Matrices(np.array(pdf["costs"].tolist(), np.int64).reshape(-1, 4, 4), np.array(audits).reshape(-1, 4, 4)))
            yield pd.DataFrame({"conv_id": pdf["conv_id"], "illegal": pdf["illegal"], "cost": cost, "audit": audit})


def _typed(df: DataFrame, like: DataFrame) -> DataFrame:
    """conv_id, which is text inside Python (a null would make a number a float), as it was."""
    return df.withColumn("conv_id", F.col("conv_id").cast(like.schema["conv_id"].dataType))


def plans(flags: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit) of ``flagged``: the cheapest edits of every conversation."""
    prepare(flags.sparkSession)
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    rows = flags.select(F.col("conv_id").cast("string").alias("conv_id"), "turn", "role", "digest", "n", place.alias("initial"), "truncated", (F.col("blank") | F.col("seen")).alias("gone"))
    order = ["conv_id", "turn", "role", "digest"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    now = materialise(dealt.select("conv_id", "n", "initial", "truncated", "gone").mapInPandas(_parts, PART), "turn-parts")
    while now.groupBy("conv_id").count().where("count > 1").limit(1).count():
        rank = F.row_number().over(W.partitionBy("conv_id").orderBy("part")) - 1
        shares = now.withColumn("_share", F.floor(rank / FAN))
        lone = F.count(F.lit(1)).over(W.partitionBy("conv_id", "_share")) == 1
        shares = shares.withColumn("_lone", lone)
        done = shares.where("NOT _lone").groupBy("conv_id", "_share").applyInPandas(lambda key, pdf: _together(pdf.drop(columns=["_share", "_lone"])), PART)
        now = materialise(shares.where("_lone").drop("_share", "_lone").unionByName(done), "turn-parts")
    found = now.select("conv_id", "illegal", "costs", "audits").mapInPandas(_planned, "conv_id string, illegal long, cost long, audit string")
    return _typed(found, flags)


class _Repair:
    """Applies an audit to the rows of one conversation, which come in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            role, self.state = ROLE_OF[self.state]
            yield role, ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        if edit == "K":
            self.state = {"s": 1, "u": 2, "a": 3}[role[0]]
        else:
            role, self.state = ROLE_OF[self.state]
        yield role, text


def _streams(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, side by side in one partition."""
    heads = planned.select(F.col("conv_id").cast("string").alias("conv_id"), F.lit(False).alias("is_row"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"))
    body = _digested(rows).select(F.col("conv_id").cast("string").alias("conv_id"), F.lit(True).alias("is_row"), "turn", "role", "digest", "text")
    both = heads.unionByName(body)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "is_row", "turn", "role", "digest").select("conv_id", "is_row", "role", "text")


def _walked(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(conv_id, role, text) of every repaired row, and (conv_id, None, None) at a conversation's end."""
    conv, now = None, None
    for pdf in batches:
        for c, is_row, role, text in zip(pdf["conv_id"].tolist(), pdf["is_row"].tolist(), pdf["role"].tolist(), pdf["text"].tolist(), strict=True):
            if not is_row:
                if now is not None:
                    yield from ((conv, r, t) for r, t in now.inserted())
                    yield conv, None, None
                conv, now = c, _Repair(text)
            else:
                yield from ((conv, r, t) for r, t in now.row(role, text))
    if now is not None:
        yield from ((conv, r, t) for r, t in now.inserted())
        yield conv, None, None


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the rows (conv_id, turn, role, text) after the edits of ``plans``, from place 1."""
    prepare(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, place = [], 0
        for conv, role, text in _walked(batches):
            place = place + 1 if role is not None else 0
            if role is not None:
                out.append((conv, place, role, text))
            if len(out) >= 1024:
                yield pd.DataFrame(out, columns=["conv_id", "place", "role", "text"], dtype=object)
                out = []
        yield pd.DataFrame(out, columns=["conv_id", "place", "role", "text"], dtype=object)

    return _typed(_streams(rows, planned).mapInPandas(run, "conv_id string, place long, role string, text string"), rows)


def repaired_digests(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): of the lines ``role:text`` of each repaired conversation, hashed as they pass."""
    prepare(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, now, lines = [], hashlib.sha256(), 0
        for conv, role, text in _walked(batches):
            if role is None:
                out.append((conv, now.hexdigest()))
                now, lines = hashlib.sha256(), 0
                if len(out) >= 4096:
                    yield pd.DataFrame(out, columns=["conv_id", "repaired_sha256"], dtype=object)
                    out = []
            else:
                now.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1
        yield pd.DataFrame(out, columns=["conv_id", "repaired_sha256"], dtype=object)

    return _typed(_streams(rows, planned).mapInPandas(run, "conv_id string, repaired_sha256 string"), rows)


def report(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of
    ``conversations`` (conv_id), from its rows."""
    flags = materialise(flagged(rows), "turn-flags")
    everyone = conversations.select("conv_id").distinct()
    meet = lambda a, b: a.join(b.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    planned = meet(meet(everyone, fault_counts(flags)), plans(flags)).select("conv_id", *(F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"))
    planned = materialise(planned, "turn-plans")
    return meet(planned, repaired_digests(rows, planned))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired rows of every damaged conversation."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return report(damaged(conversations), conversations)


def _crc32_sql(text: str) -> str:
    bits = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda a, b: {bits}), 4294967295)"


#: The closure of insertions, (from, to, cost, audit).
_CLOSED = [(0, 2, 3, "I"), (0, 3, 6, "II"), (1, 2, 3, "I"), (1, 3, 6, "II"), (2, 3, 3, "I"), (3, 2, 3, "I")]


def _oracle() -> str:
    """A recursive CTE over each conversation's rows: the best (cost, audit, text) of every state."""
    keeps = ", ".join(f"({i}, '{r}', {j})" for i, r, j in minplus.STEPS)
    new = {2: "user", 3: "assistant"}
    added = {(0, 3): "user:\\nassistant:\\n", (1, 3): "user:\\nassistant:\\n"}
    closure = ", ".join([f"({i}, {i}, 0, '', '')" for i in range(4)] + [f"({i}, {j}, {c}, '{t}', E'{added.get((i, j), new[j] + ':' + chr(92) + 'n')}')" for i, j, c, t in _CLOSED])
    return rf"""WITH RECURSIVE c0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS f FROM conversations),
c1 AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE WHEN f = 1 THEN '' WHEN f = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM c0 WHERE f <> 0),
c2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS k, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS trunc FROM c1),
c3 AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS dup, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY k) AS prev FROM c2),
steps(i, ro, j) AS (VALUES {keeps}),
closure(i, j, c, t, x) AS (VALUES {closure}),
w(conv_id, k, s, best) AS (
  SELECT q.conv_id, CAST(0 AS BIGINT), z.j, {{'c': CAST(z.c AS BIGINT), 't': z.t, 'x': z.x}} FROM (SELECT DISTINCT conv_id FROM conversations) q, closure z WHERE z.i = 0
  UNION ALL
  SELECT conv_id, k, s, min(best) FROM (
    SELECT w.conv_id, r.k, z.j AS s, {{'c': w.best.c + e.c + z.c, 't': w.best.t || e.t || z.t, 'x': w.best.x || e.x || z.x}} AS best
    FROM w JOIN c3 r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.k = w.k + 1,
      LATERAL (SELECT w.s AS j, 4 AS c, 'D' AS t, '' AS x UNION ALL
        SELECT steps.j, CASE WHEN r.trunc THEN 3 ELSE 0 END, 'K', r.role || ':' || r.text || chr(10) FROM steps WHERE steps.i = w.s AND steps.ro = r.role[1] AND NOT r.blank AND NOT r.dup UNION ALL
        SELECT steps.j, CASE WHEN r.trunc THEN 6 ELSE 3 END, 'R', CASE steps.ro WHEN 'u' THEN 'user:' ELSE 'assistant:' END || r.text || chr(10) FROM steps WHERE steps.i = w.s AND steps.ro <> 's' AND steps.ro <> r.role[1] AND NOT r.blank AND NOT r.dup) e
      JOIN closure z ON z.i = e.j) GROUP BY conv_id, k, s),
n AS (SELECT conv_id, max(k) AS k FROM w GROUP BY conv_id),
fin AS (SELECT w.conv_id, min(w.best) AS b FROM w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.k = w.k WHERE w.s IN (0, 3) GROUP BY w.conv_id),
st AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc AND NOT blank AND NOT dup) AS truncated,
  count(*) FILTER (k > 1 AND coalesce(prev || role[1], '') NOT IN ('su', 'ua', 'au')) AS illegal FROM c3 GROUP BY conv_id)
SELECT fin.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(st.blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  CAST(b.c AS BIGINT) AS cost, b.t AS audit, sha256(CASE WHEN b.x = '' THEN '' ELSE b.x[1:length(b.x) - 1] END) AS repaired_sha256 FROM fin LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM fin.conv_id"""


QUERIES = {"op11_conversation_repair": op11_conversation_repair}
ORACLES = {"op11_conversation_repair": _oracle()}
