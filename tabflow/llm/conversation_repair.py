"""Conversation structure repair (operator 13): faults of every turn and the cheapest edits that give a
conversation the shape system?, then user and assistant in turn.

1. Rows of a conversation stand by turn (null turns first; equal turns by a digest of role and text).  Equal rows of
   one turn are counted together.  A row is blank, else a duplicate (its role and text stood earlier: an
   aggregate of first turns by digest, joined back), else truncated, else sound.
2. Each row becomes one or more letters (``repair_search``); places inside a conversation cut it into blocks of
   ``BLOCK`` rows, however long it is, and only letters meet in a task.
3. A* searches each block: a conversation of one block from start to end, a longer one for the cheapest way between
   any two states of every block.  The blocks' ways are joined ``FAN`` at a time until one is left.
4. The edits, one letter a row, meet the texts again in row order; each conversation's repaired lines
   run through SHA-256 one after the other.  That digest is sequential by definition, so a long conversation
   passes through one task, row by row, in bounded memory.

``damaged`` is the contract's damage, plain column expressions; ``repair`` takes any (conversation, turn, role, text).

Edge cases: null roles, texts and key parts count as one space in ``damaged`` and ``repair``; a null conversation
id is a conversation of its own; conversations without rows after damage return zeros, an empty audit and the hash
of the empty string; an empty role can only go or be reroled; repeated rows are duplicates; no rows give no rows;
further columns are ignored; texts may be of any length.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.functions.indexing import with_index
from tabflow.llm.arrow import text_slices
from tabflow.llm.repair_search import Replay, block, ended, illegal_pairs, joined, whole
from tabflow.llm.scratch import dropped, written
from tabflow.sources.parquet import load_table

#: rows of a conversation searched together
BLOCK = 256
#: blocks whose ways are joined in one step
FAN = 64
#: rows placed by one task
PLACED_ROWS = 100_000

_BLANKS = r"[\x20\x09-\x0D]"
_WAYS = "array<struct<a: int, z: int, cost: long, audit: string>>"


def _spaced(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of the rows after the damage that their conversation and turn decide."""
    kind = F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(_spaced("text"), ".!?", "")).otherwise(_spaced("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(_spaced("role"))
    return rows.where(kind != 0) \
        .select("conv_id", "turn", role.alias("role"), text.alias("text"),
                F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")) \
        .drop("copy")


def _digest() -> Column:
    """Of role and text; the role's length keeps them apart."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))


def _faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, n, role, fault) of the distinct rows; fault: blank, truncated or empty."""
    last = F.substring(F.rtrim(F.col("text"), F.lit("\t\n\v\f\r ")), -1, 1)
    initial = F.substring("role", 1, 1)
    return rows.select(
        "conv_id", "turn", _digest().alias("digest"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("role"),
        F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").otherwise("").alias("fault")) \
        .groupBy("conv_id", "turn", "digest", "role", "fault").agg(F.count(F.lit(1)).alias("n"))


def _lettered(light: DataFrame) -> DataFrame:
    """The letters of each distinct row of ``light`` and its numbers of faulty copies."""
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = light.groupBy("conv_id", "digest").agg(F.min(order).alias("first")) \
        .select(F.col("conv_id").alias("of"), F.col("digest").alias("of_digest"), F.col("first.turn").alias("first"))
    rows = light.join(firsts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")))
    again = ~F.col("turn").eqNullSafe(F.col("first"))
    gone = F.translate("role", "suao", "1234")
    lead = F.when((F.col("fault") == "blank") | again, gone).when(F.col("fault") == "truncated", F.upper("role")) \
        .otherwise(F.col("role"))
    sound = F.col("fault") != "blank"
    # many copies of one row are cut into parts of a block's rows
    parts = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK)))) \
        .withColumn("n", F.least(F.col("n") - F.col("part") * BLOCK, F.lit(BLOCK)))
    again = again | (F.col("part") > 0)
    lead = F.when(F.col("part") > 0, gone).otherwise(lead)
    return parts.select(
        "conv_id", "turn", "digest", "part",
        F.concat(lead, F.repeat(gone, (F.col("n") - 1).cast("int"))).alias("letters"),
        F.when(sound, F.lit(0)).otherwise(F.col("n")).alias("blank"),
        F.when(sound, F.col("n") - F.when(again, 0).otherwise(1)).otherwise(F.lit(0)).alias("duplicate"),
        F.when((F.col("fault") == "truncated") & ~again, 1).otherwise(0).alias("truncated"))


def _searched(blocks: DataFrame) -> DataFrame:
    """(conv_id, block, ways, illegal, ends) of (conv_id, block, codes, only)."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "codes"):
                ways, illegal, ends = [], [], []
                for at, codes, only in zip(part.column("block").to_pylist(), part.column("codes").to_pylist(),
                                           part.column("only").to_pylist()):
                    found = [(0, 3, *whole(codes))] if only else block(codes, at == 0)
                    ways.append([dict(zip(("a", "z", "cost", "audit"), w)) for w in found])
                    illegal.append(illegal_pairs(codes))
                    ends.append(codes[0] + codes[-1])
                kind = pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), part.column("block"), pa.array(ways, kind), pa.array(illegal, pa.int64()),
                     pa.array(ends, pa.string())], names=["conv_id", "block", "ways", "illegal", "ends"])

    kind = blocks.schema["conv_id"].dataType.simpleString()
    return blocks.select("conv_id", "block", "codes", "only") \
        .mapInArrow(run, f"conv_id {kind}, block long, ways {_WAYS}, illegal long, ends string")


def _joined(parts: DataFrame) -> DataFrame:
    """``FAN`` consecutive blocks of a conversation made one."""

    def tuples(ways):
        return [(w["a"], w["z"], w["cost"], w["audit"]) for w in ways]

    @F.udf(f"struct<ways: {_WAYS}, illegal: long, ends: string>")
    def one(blocks):
        ways = joined([tuples(b["ways"]) for b in blocks])
        ends = [b["ends"] for b in blocks]
        return ([*ways], sum(b["illegal"] for b in blocks) + sum(illegal_pairs(x[-1] + y[0]) for x, y in zip(ends, ends[1:])),
                ends[0][0] + ends[-1][-1])

    return parts.groupBy("conv_id", F.floor(F.col("block") / FAN).cast("long").alias("group")) \
        .agg(F.sort_array(F.collect_list(F.struct("block", "ways", "illegal", "ends"))).alias("blocks")) \
        .select("conv_id", F.col("group").alias("block"), one("blocks").alias("made")).select("conv_id", "block", "made.*")


def _ended(parts: DataFrame) -> DataFrame:
    @F.udf("struct<cost: long, audit: string>")
    def end(ways):
        return ended([(w["a"], w["z"], w["cost"], w["audit"]) for w in ways])

    return parts.select("conv_id", "illegal", end("ways").alias("end")).select("conv_id", "illegal", "end.*")


def _hashed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): every conversation's edits come first, its rows in order behind them."""
    lines = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"),
                          F.lit(None).cast("binary").alias("digest"), F.lit("").alias("role"), F.col("audit").alias("text")) \
        .unionByName(rows.select("conv_id", F.lit(1).alias("kind"), "turn", _digest().alias("digest"), "role", "text"))
    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "digest") \
        .select("conv_id", "kind", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        state = None                            # conversation, its hash, its replay, whether a line stands

        def line(role, text):
            state[1].update((("\n" if state[3] else "") + f"{role}:{text}").encode())
            state[3] = True

        def finish():
            for role in state[2].inserted():
                line(role, "")
            return state[0], state[1].hexdigest()

        for big in batches:
            for batch in text_slices(big):
                done = []
                for conv, header, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text"))):
                    if header == 0:
                        if state is not None:
                            done.append(finish())
                        state = [conv, hashlib.sha256(), Replay(text), False]
                        continue
                    for extra in state[2].inserted():
                        line(extra, "")
                    role = state[2].row(role)
                    if role is not None:
                        line(role, text)
                if done:
                    yield _pairs(done, batch.schema.field("conv_id").type)
        if state is not None:
            yield _pairs([finish()], batch.schema.field("conv_id").type)

    return ordered.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def _pairs(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    ids, hashes = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(hashes, pa.string())],
                                      names=["conv_id", "repaired_sha256"])


def repair(rows: DataFrame, ids: DataFrame | None = None, block_rows: int = BLOCK) -> DataFrame:
    """One row per conversation of ``ids`` (conv_id; all of ``rows`` by default): gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256."""
    rows = rows.select("conv_id", "turn", _spaced("role").alias("role"), _spaced("text").alias("text"))
    letters = _lettered(written(_faults(rows), "turns"))
    placed = written(with_index(letters, [F.col("turn").isNotNull(), F.col("turn"), F.col("digest"), F.col("part")],
                                ["conv_id"],
                                name="at", rows_per_bucket=PLACED_ROWS)
                     .withColumn("block", F.floor(F.col("at") / block_rows).cast("long")), "turns-placed")
    facts = placed.groupBy("conv_id").agg(
        F.max("block").alias("blocks"), F.count_distinct("turn").alias("turns"), F.min("turn").alias("low"),
        F.max("turn").alias("high"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    facts = written(facts.select("conv_id", "blocks", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated"),
                    "conversations")
    codes = placed.groupBy("conv_id", "block") \
        .agg(F.sort_array(F.collect_list(F.struct("at", "letters"))).alias("rows")) \
        .select("conv_id", "block", F.array_join("rows.letters", "").alias("codes"))
    known = facts.select(F.col("conv_id").alias("of"), (F.col("blocks") == 0).alias("only"))
    searched = written(_searched(codes.join(known, F.col("conv_id").eqNullSafe(F.col("of")))
                                 .select("conv_id", "block", "codes", "only")), "searched")
    short = searched.join(known, F.col("conv_id").eqNullSafe(F.col("of")))
    ends = short.where("only").select("conv_id", "illegal", F.col("ways")[0]["cost"].alias("cost"),
                                      F.col("ways")[0]["audit"].alias("audit"))
    most = facts.agg(F.max("blocks")).first()[0] or 0
    if most:
        parts = short.where(~F.col("only")).select("conv_id", "block", "ways", "illegal", "ends")
        while most:
            parts, most = written(_joined(parts), "joined"), most // FAN
        ends = ends.unionByName(_ended(parts))
    ends = written(ends, "audits")
    hashed = _hashed(rows, ends)
    everyone = (ids if ids is not None else rows).select("conv_id").distinct()
    # unioned and aggregated rather than joined: each conversation has one row of each kind at most
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def wide(df: DataFrame) -> DataFrame:
        return df.select("conv_id", *[F.col(c) if c in df.columns else F.lit(None).cast("long").alias(c) for c in numbers],
                         *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)
                           for c in ("audit", "repaired_sha256")])

    out = wide(everyone).unionByName(wide(facts.drop("blocks"))).unionByName(wide(ends)).unionByName(wide(hashed)) \
        .groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers],
                                F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
                                F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest()))
                                .alias("repaired_sha256"))
    out = written(out, "repaired")
    dropped(placed, facts, searched, ends)
    return out


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load_table(spark, sf_dir, "conversations")
    return repair(damaged(rows), rows)


#: the edits of the SQL are those of the contract; the least audit is found by dynamic programming, place by place
OP13_SQL = """
WITH RECURSIVE
table_of_crc AS (
  SELECT list(crc ORDER BY byte) AS crcs FROM (
    SELECT byte, list_reduce(list_prepend(byte::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
             lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS crc
    FROM range(256) t(byte))),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hit AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(c)::BIGINT FOR c IN string_split(key, '')]),
               lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS kind
  FROM keyed, table_of_crc),
rows AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hit WHERE kind <> 0),
placed AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS initial,
         rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS core,
         sha256(length(role) || ':' || role || text) AS digest,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS pos
  FROM rows),
faults AS (
  SELECT *, CASE WHEN core = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                 WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM placed),
facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate,
         count_if(fault = 'truncated') AS truncated,
         count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id),
inserts(state, next, letters, cost, lines) AS (      -- 0 start, 1 after s, 2 after u, 3 after a
  VALUES (0, 0, '', 0, []::VARCHAR[]), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []),
         (0, 2, 'I', 2, ['user:']), (1, 2, 'I', 2, ['user:']), (2, 3, 'I', 2, ['assistant:']), (3, 2, 'I', 2, ['user:']),
         (0, 3, 'II', 4, ['user:', 'assistant:']), (1, 3, 'II', 4, ['user:', 'assistant:'])),
edits(state, next, letter, cost, initial, role) AS (
  VALUES (0, 0, 'D', 3, NULL, NULL), (1, 1, 'D', 3, NULL, NULL), (2, 2, 'D', 3, NULL, NULL), (3, 3, 'D', 3, NULL, NULL),
         (0, 1, 'K', 0, 's', NULL), (0, 2, 'K', 0, 'u', NULL), (1, 2, 'K', 0, 'u', NULL), (2, 3, 'K', 0, 'a', NULL),
         (3, 2, 'K', 0, 'u', NULL), (0, 2, 'R', 2, NULL, 'user'), (1, 2, 'R', 2, NULL, 'user'),
         (2, 3, 'R', 2, NULL, 'assistant'), (3, 2, 'R', 2, NULL, 'user')),
ways AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, 0 AS state, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} AS best FROM faults
  UNION ALL
  SELECT w.conv_id, f.pos, e.next,
         min({'cost': (w.best).cost + i.cost + e.cost
                      + CASE WHEN e.letter <> 'D' AND f.fault = 'truncated' THEN 1 ELSE 0 END,
              'audit': (w.best).audit || i.letters || e.letter,
              'lines': (w.best).lines || i.lines || CASE WHEN e.letter = 'D' THEN []::VARCHAR[]
                                                        ELSE [coalesce(e.role, f.role) || ':' || f.text] END})
  FROM ways w JOIN faults f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.pos = w.pos + 1
       JOIN inserts i ON i.state = w.state JOIN edits e ON e.state = i.next
  WHERE (e.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate')) AND (e.letter <> 'K' OR e.initial = f.initial)
  GROUP BY w.conv_id, f.pos, e.next),
done AS (
  SELECT w.conv_id, min({'cost': (w.best).cost + i.cost, 'audit': (w.best).audit || i.letters,
                         'lines': (w.best).lines || i.lines}) AS best
  FROM ways w JOIN facts f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.pos = f.n
       JOIN inserts i ON i.state = w.state AND i.next IN (0, 3)
  GROUP BY w.conv_id)
SELECT c.conv_id, coalesce(f.gaps, 0)::BIGINT AS gaps, coalesce(f.blank, 0)::BIGINT AS blank,
       coalesce(f.duplicate, 0)::BIGINT AS duplicate, coalesce(f.truncated, 0)::BIGINT AS truncated,
       coalesce(f.illegal, 0)::BIGINT AS illegal, coalesce((d.best).cost, 0)::BIGINT AS cost,
       coalesce((d.best).audit, '') AS audit, sha256(coalesce(array_to_string((d.best).lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
     LEFT JOIN facts f ON c.conv_id IS NOT DISTINCT FROM f.conv_id
     LEFT JOIN done d ON c.conv_id IS NOT DISTINCT FROM d.conv_id
"""
