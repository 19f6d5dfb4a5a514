"""Repair of a conversation's structure at least cost, worked out once for each suffix that conversations share.

A row of a conversation is kept (cost 0), given another role (1) or deleted (2), and empty rows may be inserted
anywhere (5), so that the role initials left read ``(s?(ua)+)?``. Blank rows and repeats must be deleted; a
truncated row that stays costs 5 more. Of the cheapest edits those whose initials (K, R, D, I in order: the audit)
come first in ASCII order are taken.

Method: a row is one symbol (role initial, fault), a conversation a word over such symbols. All words go into one
automaton that shares suffixes: its nodes are the distinct suffixes, reached from the end. For each node and each pair
of grammar states (before the suffix, behind it) the least cost and the first audit of that cost are found once, from
the node one symbol shorter, and serve every conversation that ends alike. The words are sorted from the end within
the parts of a range partitioning, so a task builds its nodes depth first and holds one path of them; a suffix at the
edge of two parts is worked out in both.

Conversations longer than ``BLOCK`` rows are words for each block of consecutive rows; their tables are multiplied
(least cost over the state in between) in groups of ``FOLD`` until one is left. This gives the same audit: two audits
of equal cost between the same states over the same rows are never prefixes of each other, since what the longer one
had more could only be insertions.

Scale: rows are put into order by a range partitioning on conversation, turn and text, with a row number behind, so
a conversation or a repeated row may hold any share of all rows. Equal rows are found by a grouped minimum, faults
counted with partial aggregation, tables joined by word. Only the hash over a repaired conversation reads it in one
task, since such a hash has no parts: its rows stream through in order, one batch at a time. An audit has to fit a row.

Edge cases: nulls in conv_id, turn, role and text are one space where they are hashed or read as text; a null conv_id
is a conversation of its own; null turns come first; rows of one turn come by role and a digest of the text, equal
rows one behind the other; empty texts are blank, very long ones are read whole; a role of another initial than s, u
or a cannot stay as it is; a conversation that damage leaves no rows has zeros, an empty audit and the hash of the
empty text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.session import broadcast_if_small, materialize

#: Rows of a word; 8 bits of the row number.
BLOCK_BITS = 8
FOLD = 64
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Symbols of the roles s, u, a and others: fine, truncated, to be deleted.
FINE, OPEN, GONE = "suax", "SUAX", "0123"
#: Grammar states: nothing yet, behind s, behind u, behind a; where a kept initial leads.
STEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
#: Where a new role leads: to assistant behind a user, to user elsewhere.
TURN = (2, 2, 3, 2)
LEGAL = {"su", "ua", "au"}

Table = list[tuple[int, str] | None]


def _initial(symbol: str) -> str:
    return FINE[max(FINE.find(symbol), OPEN.find(symbol), GONE.find(symbol))]


def _first(found: list[tuple[int, str] | None]) -> tuple[int, str] | None:
    return min((x for x in found if x is not None), default=None)


def _and(cost: int, letter: str, rest: tuple[int, str] | None) -> tuple[int, str] | None:
    return None if rest is None else (cost + rest[0], letter + rest[1])


def _with_inserts(table: Table) -> Table:
    """Up to two insertions ahead; more lead back to a state that was cheaper before."""
    for _ in range(2):
        table = [_first([table[4 * p + q], _and(INSERT, "I", table[4 * TURN[p] + q])]) for p in range(4) for q in range(4)]
    return table


#: The table of the empty word, by 4 * state before + state behind.
EMPTY: Table = _with_inserts([(0, "") if p == q else None for p in range(4) for q in range(4)])


def longer(symbol: str, rest: Table) -> Table:
    """The table of a suffix that has ``symbol`` ahead of one whose table is ``rest``."""
    out: Table = []
    late, role = TRUNCATED * (symbol in OPEN), _initial(symbol)
    for p in range(4):
        kept = STEP.get((role, p))
        for q in range(4):
            found = [_and(DELETE, "D", rest[4 * p + q])]
            if symbol not in GONE:
                found.append(_and(REROLE + late, "R", rest[4 * TURN[p] + q]))
                found.append(None if kept is None else _and(KEEP + late, "K", rest[4 * kept + q]))
            out.append(_first(found))
    return _with_inserts(out)


def joined(left: Table, right: Table) -> Table:
    """The table of two words, one behind the other."""
    out: Table = []
    for p in range(4):
        for q in range(4):
            ways = [(left[4 * p + m], right[4 * m + q]) for m in range(4)]
            out.append(_first([(a[0] + b[0], a[1] + b[1]) for a, b in ways if a is not None and b is not None]))
    return out


TABLE = "word string, illegal long, cost array<int>, audit array<string>"


def _columns(table: Table) -> tuple[list, list]:
    return [x and x[0] for x in table], [x and x[1] for x in table]


def _rows(cost: list, audit: list) -> Table:
    return [None if a is None else (int(c), a) for c, a in zip(cost, audit, strict=True)]


def automaton(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tables of words that come sorted from the end. ``path`` is the suffix at hand, read from the end, with one
    node for each of its symbols; what the next word shares with it stays."""
    path, nodes = "", [(EMPTY, 0)]
    for batch in batches:
        out = []
        for word in batch["word"]:
            back = word[::-1]
            shared = next((n for n, (a, b) in enumerate(zip(path, back, strict=False)) if a != b), min(len(path), len(back)))
            del nodes[shared + 1 :]
            for n in range(shared, len(back)):
                table, illegal = nodes[n]
                bad = n > 0 and _initial(back[n]) + _initial(back[n - 1]) not in LEGAL
                nodes.append((longer(back[n], table), illegal + bad))
            path = back
            out.append((word, nodes[-1][1], *_columns(nodes[-1][0])))
        yield pd.DataFrame(out, columns=["word", "illegal", "cost", "audit"])


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) after the damage that a checksum of conv_id and turn decides; ``conv`` tells
    conversations apart, null ones too."""
    hit = F.pmod(F.crc32(F.concat_ws(":", _text("conv_id"), _text("turn"))), F.lit(20))
    rows = conversations.select(_conv(), "turn", _text("role").alias("role"), _text("text").alias("text"), hit.alias("hit")).where("hit <> 0")
    text = F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.sequence(F.lit(1), F.when(F.col("hit") == 3, 2).otherwise(1))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def _conv() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv")


def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, turn, role, text) with ``at``, which grows along each conversation, and what is seen of each row:
    ``digest`` of role and text, ``blank``, ``open`` (the last visible character ends no sentence)."""
    seen = F.rtrim(F.col("text"), F.lit(SPACE))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    rows = rows.select(
        "conv", "turn", "role", "text", digest.alias("digest"), (seen == "").alias("blank"),
        (~F.substring(seen, -1, 1).isin(".", "!", "?")).alias("open"), F.monotonically_increasing_id().alias("spread"),
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("spread")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("spread")
    return materialize(rows.withColumn("at", F.monotonically_increasing_id()), "turns-in-order")


def symbols(rows: DataFrame) -> DataFrame:
    """conv, turn, at, fault (b, d, t or empty) and symbol of ordered rows; one row each, without texts."""
    first = rows.groupBy("conv", "digest").agg(F.min("at").alias("first"))
    light = rows.select("conv", "digest", "turn", "at", "blank", "open", F.substring("role", 1, 1).alias("initial")).join(first, ["conv", "digest"])
    fault = F.when(F.col("blank"), "b").when(F.col("at") > F.col("first"), "d").when(F.col("open"), "t").otherwise("")
    out = light.select("conv", "turn", "at", fault.alias("fault"), F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x").alias("role"))
    as_open, as_gone = F.translate("role", FINE, OPEN), F.translate("role", FINE, GONE)
    symbol = F.when(F.col("fault").isin("b", "d"), as_gone).when(F.col("fault") == "t", as_open).otherwise(F.col("role"))
    return materialize(out.withColumn("symbol", symbol), "turn-symbols")


def tables(symbols_: DataFrame) -> DataFrame:
    """The table of each block of each conversation: conv, block, head, tail (role initials at its ends), illegal,
    cost, audit."""
    block = F.shiftright("at", BLOCK_BITS).alias("block")
    pairs = F.sort_array(F.collect_list(F.struct("at", "symbol")))
    words = symbols_.groupBy("conv", block).agg(F.array_join(F.transform(pairs, lambda x: x["symbol"]), "").alias("word"))
    words = materialize(words, "words")
    back = F.reverse(F.col("word"))
    nodes = words.select("word").distinct().repartitionByRange(back).sortWithinPartitions(back).mapInPandas(automaton, TABLE)
    nodes = materialize(nodes, "word-tables")
    plain = F.translate("word", OPEN + GONE, FINE + FINE)
    ends = [F.substring(plain, 1, 1).alias("head"), F.substring(plain, -1, 1).alias("tail")]
    return words.join(broadcast_if_small(nodes, 20_000), "word").select("conv", "block", *ends, "illegal", "cost", "audit")


BLOCKS = "conv string, block long, head string, tail string, illegal long, cost array<int>, audit array<string>"


def _fold(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("block")
    table, illegal, tail = None, 0, ""
    for row in group.itertuples():
        one = _rows(row.cost, row.audit)
        illegal += row.illegal + (bool(tail) and tail + row.head not in LEGAL)
        table, tail = one if table is None else joined(table, one), row.tail
    cost, audit = _columns(table)
    return pd.DataFrame([(*key, group["head"].iloc[0], tail, illegal, cost, audit)], columns=["conv", "block", "head", "tail", "illegal", "cost", "audit"])


def folded(blocks: DataFrame) -> DataFrame:
    """One table for each conversation: those of several blocks are multiplied, ``FOLD`` at a time."""
    blocks = materialize(blocks, "block-tables")
    several = materialize(blocks.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "several-blocks")
    most = several.agg(F.max("n")).first()[0] or 0
    if not most:
        return blocks
    alone = blocks.join(broadcast_if_small(several), "conv", "left_anti")
    # Blocks of a conversation are numbered anew without gaps; one short row for each block.
    number = several.join(blocks.select("conv", "block"), "conv").select("conv", "block", (F.row_number().over(Window.partitionBy("conv").orderBy("block")) - 1).cast("long").alias("nth"))
    rest = blocks.join(number, ["conv", "block"]).drop("block").withColumnRenamed("nth", "block")
    while most > 1:
        rest = materialize(rest.groupBy("conv", F.expr(f"block div {FOLD}")).applyInPandas(_fold, BLOCKS), "folded")
        most = -(-most // FOLD)
    return alone.unionByName(rest)


def cheapest(symbols_: DataFrame) -> DataFrame:
    """conv, illegal, cost and audit of each conversation: from the first grammar state to one that may end."""
    way = lambda q: F.struct(F.col("cost")[q].alias("cost"), F.col("audit")[q].alias("audit"))
    best = folded(tables(symbols_)).select("conv", "illegal", F.array_min(F.array(way(0), way(3))).alias("best"))
    return best.select("conv", "illegal", F.col("best.cost").cast("long").alias("cost"), F.col("best.audit").alias("audit"))


class _Walk:
    """Edits conversations of which the audit comes first (at -1), then the rows in order."""

    conv, audit, at, state = "", "", 0, 0

    def _turn(self) -> str:
        self.at, self.state = self.at + 1, TURN[self.state]
        return "assistant" if self.state == 3 else "user"

    def pieces(self, batch: pd.DataFrame) -> Iterator[tuple[str, str | None, str]]:
        """conv, role and text of the repaired rows; a role of None where a conversation begins."""
        for row in batch.itertuples(index=False):
            if row.at < 0:
                self.conv, self.audit, self.at, self.state = row.conv, row.text, 0, 0
                yield row.conv, None, ""
            elif self.audit[self.at] == "R":
                yield row.conv, self._turn(), row.text
            else:
                if self.audit[self.at] == "K":
                    self.state = STEP[row.role[0], self.state]
                    yield row.conv, row.role, row.text
                self.at += 1
            while self.audit[self.at : self.at + 1] == "I":
                yield row.conv, self._turn(), ""


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hash of each repaired conversation, whose rows stream through."""
    walk, conv, first, hash_ = _Walk(), None, True, hashlib.sha256()
    for batch in batches:
        out = []
        for at, role, text in walk.pieces(batch):
            if role is None:
                if conv is not None:
                    out.append((conv, hash_.hexdigest()))
                conv, first, hash_ = at, True, hashlib.sha256()
            else:
                hash_.update((("" if first else "\n") + role + ":" + text).encode())
                first = False
        yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])
    if conv is not None:
        yield pd.DataFrame([(conv, hash_.hexdigest())], columns=["conv", "repaired_sha256"])


def _applied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    walk, n = _Walk(), 0
    for batch in batches:
        out = []
        for conv, role, text in walk.pieces(batch):
            n = 0 if role is None else n + 1
            if role is not None:
                out.append((conv, n - 1, role, text))
        yield pd.DataFrame(out, columns=["conv", "nth", "role", "text"])


def _stream(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Conversations whole and in order within tasks: the audit, then the rows."""
    heads = answers.select("conv", F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = heads.unionByName(rows.select("conv", "at", "role", "text"))
    return both.repartition("conv").sortWithinPartitions("conv", "at")


def repair_report(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations`` (conv_id, turn, role, text): what damage did to it, the cheapest
    repair and a hash of the repaired conversation."""
    rows = ordered(damaged(conversations))
    marks = symbols(rows)
    count = lambda x: F.count(F.when(F.col("fault") == x, 1))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long")
    seen = marks.groupBy("conv").agg(gaps.alias("gaps"), count("b").alias("blank"), count("d").alias("duplicate"), count("t").alias("truncated"))
    answers = materialize(cheapest(marks), "audits")
    hashes = _stream(rows, answers).mapInPandas(_hashes, "conv string, repaired_sha256 string")
    every = conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("rows")).select("conv_id", _conv())
    out = every.join(seen, "conv", "left").join(answers, "conv", "left").join(hashes, "conv", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired conversations themselves, of rows as they are (no damage): conv (``=`` and the conv_id; empty where
    it is null), nth, role, text."""
    rows = ordered(conversations.select(_conv(), "turn", _text("role").alias("role"), _text("text").alias("text")))
    return _stream(rows, cheapest(symbols(rows))).mapInPandas(_applied, "conv string, nth long, role string, text string")


#: Checksums by the table of their polynomial for half a byte; then row by row, the best edits to each grammar state.
ORACLE = r"""
WITH RECURSIVE k AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, [CAST(ascii(c) AS BIGINT) FOR c IN string_split(name, '')]),
      lambda crc, b: xor(xor(xor(crc, b) >> 4, half[CAST(xor(crc, b) & 15 AS INT) + 1]) >> 4,
        half[CAST(xor(xor(crc, b) >> 4, half[CAST(xor(crc, b) & 15 AS INT) + 1]) & 15 AS INT) + 1])), 4294967295) % 20 AS hit
  FROM k, (SELECT [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
    3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::BIGINT[] AS half)),
d AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS again
  FROM h WHERE hit <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), again) AS nth FROM d),
m AS (
  SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY nth) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
         WHEN nth > min(nth) OVER (PARTITION BY conv_id, role, text) THEN 'd'
         WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault
  FROM o),
-- best[1..4]: cost and audit of reaching nothing yet, behind s, behind u, behind a.
walk AS (
  SELECT conv_id, 0::BIGINT AS nth, 0 AS ins, [{'c': 0, 'a': ''}, NULL, NULL, NULL]::STRUCT(c INTEGER, a VARCHAR)[] AS best FROM (SELECT DISTINCT conv_id FROM m)
  UNION ALL
  SELECT w.conv_id, CASE WHEN w.ins < 2 THEN w.nth ELSE w.nth + 1 END, (w.ins + 1) % 3,
    CASE WHEN w.ins < 2 THEN
      [best[1], best[2],
       list_min([best[3], {'c': best[1].c + 5, 'a': best[1].a || 'I'}, {'c': best[2].c + 5, 'a': best[2].a || 'I'}, {'c': best[4].c + 5, 'a': best[4].a || 'I'}].list_filter(lambda x: x.c IS NOT NULL)),
       list_min([best[4], {'c': best[3].c + 5, 'a': best[3].a || 'I'}].list_filter(lambda x: x.c IS NOT NULL))]
    ELSE
      [list_min([{'c': best[1].c + 2, 'a': best[1].a || 'D'}].list_filter(lambda x: x.c IS NOT NULL)),
       list_min([{'c': best[2].c + 2, 'a': best[2].a || 'D'}, CASE WHEN keeps AND initial = 's' THEN {'c': best[1].c + late, 'a': best[1].a || 'K'} END].list_filter(lambda x: x.c IS NOT NULL)),
       list_min([{'c': best[3].c + 2, 'a': best[3].a || 'D'},
         CASE WHEN keeps AND initial = 'u' THEN {'c': best[1].c + late, 'a': best[1].a || 'K'} END, CASE WHEN keeps AND initial = 'u' THEN {'c': best[2].c + late, 'a': best[2].a || 'K'} END,
         CASE WHEN keeps AND initial = 'u' THEN {'c': best[4].c + late, 'a': best[4].a || 'K'} END, CASE WHEN keeps THEN {'c': best[1].c + late + 1, 'a': best[1].a || 'R'} END,
         CASE WHEN keeps THEN {'c': best[2].c + late + 1, 'a': best[2].a || 'R'} END, CASE WHEN keeps THEN {'c': best[4].c + late + 1, 'a': best[4].a || 'R'} END].list_filter(lambda x: x.c IS NOT NULL)),
       list_min([{'c': best[4].c + 2, 'a': best[4].a || 'D'}, CASE WHEN keeps AND initial = 'a' THEN {'c': best[3].c + late, 'a': best[3].a || 'K'} END,
         CASE WHEN keeps THEN {'c': best[3].c + late + 1, 'a': best[3].a || 'R'} END].list_filter(lambda x: x.c IS NOT NULL))]
    END
  FROM walk w LEFT JOIN (SELECT *, fault IN ('', 't') AS keeps, CASE WHEN fault = 't' THEN 5 ELSE 0 END AS late FROM m) m
    ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.nth = w.nth + 1
  WHERE w.ins < 2 OR m.nth IS NOT NULL),
best AS (
  SELECT conv_id, list_min([best[1], best[4]]) AS b FROM walk WHERE ins = 2
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY nth DESC) = 1),
letters AS (SELECT conv_id, b, unnest(string_split(b.a, '')) AS letter, generate_subscripts(string_split(b.a, ''), 1) AS spot FROM best WHERE b.a <> ''),
numbered AS (
  SELECT *, CASE WHEN letter <> 'I' THEN sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY spot) END AS nth FROM letters),
said AS (
  SELECT n.conv_id, n.spot, CASE WHEN letter = 'K' THEN m.role END AS role, CASE WHEN letter = 'I' THEN '' ELSE m.text END AS text,
    -- Roles alternate behind the system row, so a new one is told by the number of rows said since.
    row_number() OVER (PARTITION BY n.conv_id ORDER BY n.spot) - CASE WHEN first_value(CASE WHEN letter = 'K' THEN m.initial ELSE 'u' END) OVER (PARTITION BY n.conv_id ORDER BY n.spot) = 's' THEN 1 ELSE 0 END AS place
  FROM numbered n LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM n.conv_id AND m.nth = n.nth WHERE letter <> 'D'),
mended AS (
  SELECT conv_id, sha256(string_agg(coalesce(role, CASE WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY spot)) AS repaired_sha256 FROM said GROUP BY conv_id),
seen AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
    count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE nth > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM m GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.b.c, 0)::BIGINT AS cost, coalesce(b.b.a, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN seen s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN mended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
