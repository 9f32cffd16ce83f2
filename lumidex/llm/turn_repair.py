"""Conversation structure repair by a dynamic program over time-major tensors (operator 13).

A repaired conversation is empty, or an optional system turn and then one or more pairs of
a user's and an assistant's turn. Each row is kept (0), given another role (2) or deleted
(3; blank and duplicate rows have to be), empty turns are inserted anywhere (2 each), and a
truncated row that stays adds 1. What follows a row depends only on which of four states
its predecessors left: nothing yet, system, user, assistant. So conversations are dealt
into buckets by length (powers of two); in a bucket all conversations' costs to go, from
the last turn back, are one array of turns x states x conversations, filled a turn at a
time for all conversations at once; the same arrays then give all conversations' edits a
turn at a time from the first: at each place the least letter of those that lose nothing,
so ties end in the ASCII-least edits.

Scale: rows are sorted by conversation and turn across range partitions: one shuffle. A
conversation that lies inside one partition, nearly every one, is repaired in that task as
it streams by; a task holds BATCH_ROWS rows or BATCH_CHARS characters and the rest of one
conversation. A conversation that a range border cuts, or that is longer than that, such as
one with a third of all rows, is written as pieces. Of these only a byte and a 16-byte mark
for each row meet in one task, some hundred bytes a row with the costs (the edits that are
the result have one letter a row, too); the edits go back to the pieces by a join whose key
is one piece, so texts of a long conversation stay spread over tasks. Equal rows are dealt
by source partition as well, as their order does not matter.

Defined results: rows of a null conversation id are one conversation; null roles and texts
are one space, so null texts are blank; null turns come first and do not count for gaps;
equal turns are ordered by role, first 64 characters and hash of the text; repeated rows are
duplicates; an empty role has no initial and cannot be kept; an empty table gives no rows;
very long texts are never cut. Extra columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumidex.llm.common import saved, table

#: Rows and characters that a task gathers before it repairs them; a conversation beyond that is cut into pieces.
BATCH_ROWS, BATCH_CHARS = 20_000, 1 << 24
#: States: what precedes. A row's or an inserted turn's role leads on; from system, assistant and nothing the next is a user's turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
RENAME, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
NEVER = 1 << 40
#: Bits of a row's code: role initial (0 other, 1 s, 2 u, 3 a), blank, truncated.
BLANK, TRUNCATED = 4, 8
#: An edit's letter and what it does: D delete, u and a insert a user's or assistant's turn, K keep, U and A rename to user or assistant.
TO_AUDIT = bytes.maketrans(b"uaUA", b"IIRR")
ROLES = {ord("u"): "user", ord("a"): "assistant", ord("U"): "user", ord("A"): "assistant"}
BLANKS = " \t\n\x0b\f\r"


def costs_to_go(codes: np.ndarray, must: np.ndarray) -> np.ndarray:
    """(turns + 1, states, conversations): the least cost from before each turn to the end.

    codes and must (turns, conversations): codes of rows, 255 beyond a conversation's end;
    whether a row has to go.
    """
    turns, n = codes.shape
    cost = np.empty((turns + 1, 4, n), np.int64)
    cost[turns] = np.array([0, 2 * INSERT, INSERT, 0])[:, None]
    for t in range(turns - 1, -1, -1):
        after, code = cost[t + 1], codes[t]
        initial, extra = code & 3, np.where(must[t], NEVER, np.where(code & TRUNCATED, CUT_OFF, 0))
        here = after + DELETE
        renamed = np.stack([after[USER], after[USER], after[ASSISTANT], after[USER]]) + RENAME + extra
        np.minimum(here, renamed, out=here)
        # what may be kept: s from nothing; u from all but user; a from user
        here[NOTHING] = np.minimum(here[NOTHING], np.where(initial == SYSTEM, after[SYSTEM] + extra, NEVER))
        kept_user = np.where(initial == USER, after[USER] + extra, NEVER)
        for state in (NOTHING, SYSTEM, ASSISTANT):
            here[state] = np.minimum(here[state], kept_user)
        here[USER] = np.minimum(here[USER], np.where(initial == ASSISTANT, after[ASSISTANT] + extra, NEVER))
        user, assistant = here[USER].copy(), here[ASSISTANT].copy()
        here[USER] = np.minimum(user, assistant + INSERT)
        here[ASSISTANT] = np.minimum(assistant, user + INSERT)
        for state in (NOTHING, SYSTEM):
            here[state] = np.minimum(here[state], here[USER] + INSERT)
        ended = code == 255
        here[:, ended] = after[:, ended]
        cost[t] = here
    return cost


def edits(codes: np.ndarray, must: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """(conversations, turns + 1, 3): before each turn up to two inserted turns, then what is done with it; 0 is nothing."""
    turns, n = codes.shape
    out = np.zeros((turns + 1, 3, n), np.uint8)
    state, lanes = np.zeros(n, np.int64), np.arange(n)
    leads = np.array([USER, USER, ASSISTANT, USER])
    inserted, renamed = np.frombuffer(b"uuau", np.uint8), np.frombuffer(b"UUAU", np.uint8)
    for t in range(turns + 1):
        ended = codes[t] == 255 if t < turns else np.ones(n, bool)
        open_ = ~ended if t < turns else np.ones(n, bool)
        for place in range(3):
            if not open_.any():
                break
            left = cost[t, state, lanes]
            lead = leads[state]
            may_insert = open_ & (cost[t, lead, lanes] + INSERT == left)
            if t < turns:
                after = cost[t + 1]
                extra = np.where(must[t], NEVER, np.where(codes[t] & TRUNCATED, CUT_OFF, 0))
                gone = open_ & (after[state, lanes] + DELETE == left)
                initial = codes[t] & 3
                fits = np.where(initial == SYSTEM, state == NOTHING, (initial > 0) & (initial == lead))
                kept = open_ & fits & (np.where(fits, after[initial, lanes], NEVER) + extra == left)
                out[t, 2][gone] = ord("D")
                may_insert &= ~gone
                kept &= ~gone & ~may_insert
                other = open_ & ~gone & ~may_insert & ~kept
                out[t, 2][kept], out[t, 2][other] = ord("K"), renamed[state[other]]
                state = np.where(kept, initial, np.where(other, lead, state))
            if place < 2:
                out[t, place][may_insert] = inserted[state[may_insert]]
            state = np.where(may_insert, lead, state)
            open_ = may_insert
    return out.transpose(2, 0, 1)


def repairs(codes: list[np.ndarray], must: list[np.ndarray]) -> tuple[list[np.ndarray], list[int]]:
    """(edits as (rows + 1, 3) arrays of letters, cost) of each conversation; the last row of edits is what follows the last turn."""
    found: list = [None] * len(codes)
    total = [0] * len(codes)
    sizes = np.array([max(1, len(c) - 1).bit_length() for c in codes])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        width = 1 << int(size)
        step = max(1, (1 << 18) // width)
        for i in range(0, len(at), step):
            lanes = at[i : i + step]
            turns = max(len(codes[j]) for j in lanes)
            code, gone = np.full((turns, len(lanes)), 255, np.uint8), np.zeros((turns, len(lanes)), bool)
            for k, j in enumerate(lanes):
                code[: len(codes[j]), k], gone[: len(codes[j]), k] = codes[j], must[j]
            cost = costs_to_go(code, gone)
            plan = edits(code, gone, cost)
            for k, j in enumerate(lanes):
                rows = len(codes[j])
                found[j] = np.concatenate([plan[k, :rows], plan[k, turns:]])  # no edits between a conversation's end and the bucket's
                total[j] = int(cost[0, NOTHING, k])
    return found, total


def duplicates(marks: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether an equal mark (n, 2) stands earlier in the same conversation."""
    order = np.lexsort((np.arange(len(marks)), marks[:, 1], marks[:, 0], owner))
    same = (owner[order][1:] == owner[order][:-1]) & (marks[order][1:] == marks[order][:-1]).all(1)
    out = np.zeros(len(marks), bool)
    out[order[1:]] = same
    return out


def judged(codes: list[np.ndarray], marks: list[np.ndarray], turns: list[list[tuple]]) -> list[tuple]:
    """(edits, gaps, blank, duplicate, truncated, illegal, cost) of each conversation.

    turns: for each piece of it (least turn, greatest turn, how many), None for a piece without.
    """
    owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    again = duplicates(np.concatenate(marks), owner) if len(owner) else np.zeros(0, bool)
    parts = np.split(again, np.cumsum([len(c) for c in codes])[:-1])
    clean, must, counts = [], [], []
    for code, dup in zip(codes, parts, strict=True):
        blank = (code & BLANK) > 0
        dup = dup & ~blank
        cut = ((code & TRUNCATED) > 0) & ~blank & ~dup
        initial = code & 3
        legal = ((initial[:-1] == SYSTEM) & (initial[1:] == USER)) | ((initial[:-1] == USER) & (initial[1:] == ASSISTANT)) | ((initial[:-1] == ASSISTANT) & (initial[1:] == USER))
        clean.append((initial | np.where(cut, TRUNCATED, 0)).astype(np.uint8))
        must.append(blank | dup)
        counts.append((int(blank.sum()), int(dup.sum()), int(cut.sum()), int((~legal).sum())))
    plans, costs = repairs(clean, must)
    out = []
    for plan, cost, count, spans in zip(plans, costs, counts, turns, strict=True):
        spans = [s for s in spans if s is not None]
        distinct = sum(s[2] for s in spans) - sum(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        gaps = spans[-1][1] - spans[0][0] + 1 - distinct if spans else 0
        out.append((plan, gaps, *count, cost))
    return out


def rendered(plan: np.ndarray, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts of the repaired rows; plan may have one more row than there are texts."""
    new_roles, new_texts = [], []
    for i, (first, second, done) in enumerate(plan.tolist()):
        for x in (first, second):
            if x:
                new_roles.append(ROLES[x])
                new_texts.append("")
        if done and done != 68:  # D
            new_roles.append(ROLES.get(done) or roles[i])
            new_texts.append(texts[i])
    return new_roles, new_texts


def letters(plan: np.ndarray) -> str:
    flat = plan.ravel()
    return flat[flat > 0].tobytes().translate(TO_AUDIT).decode("ascii")


def _span(turns: np.ndarray) -> tuple | None:
    known = turns[~pd.isna(turns)]
    if not len(known):
        return None
    known = known.astype(np.int64)
    return int(known[0]), int(known[-1]), int(1 + (known[1:] != known[:-1]).sum())


#: What a task writes: of a whole conversation its repaired rows and figures, of a piece its damaged rows, codes and marks.
FIGURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
OUT = "conv string, conv_id {kind}, part int, idx long, whole boolean, n_pieces long, audit string, roles array<string>, texts array<string>, codes binary, marks binary, t_min long, t_max long, t_n long, " + FIGURES
NAMES = [x.split()[0] for x in OUT.split(", ")]


def _code(role: Column, text: Column) -> Column:
    ended = F.rtrim(text, F.lit(BLANKS))
    initial = F.substring(role, 1, 1)
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0)
    fault = F.when(ended == "", BLANK).when(~F.right(ended, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    return (kind + fault).cast("int")


def _sorted_rows(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) without nulls in role and text, with code and mark, in order of conversation and turn across partitions."""
    conv = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    mark = F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), F.col("role"), F.col("text"))))
    keyed = rows.select(
        conv.alias("conv"), "conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", _code(F.col("role"), F.col("text")).alias("code"), mark.alias("mark"),
        F.substring("text", 1, 64).alias("head"), F.xxhash64("text").alias("hash"), F.spark_partition_id().alias("source"),
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("hash"), F.col("source")]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("head", "hash", "source")


class _Held:
    """Rows of one conversation that a task has not written yet."""

    def __init__(self, conv, conv_id):
        self.conv, self.conv_id, self.frames, self.rows, self.chars, self.written = conv, conv_id, [], 0, 0, 0

    def add(self, pdf: pd.DataFrame) -> None:
        self.frames.append(pdf)
        self.rows += len(pdf)
        self.chars += int(pdf["text"].str.len().sum())

    def values(self) -> tuple:
        pdf = self.frames[0] if len(self.frames) == 1 else pd.concat(self.frames, ignore_index=True)
        return pdf["code"].to_numpy(np.uint8), np.frombuffer(b"".join(pdf["mark"]), "<u8").reshape(-1, 2), pdf["turn"].to_numpy(object), pdf["role"].tolist(), pdf["text"].tolist()

    def piece(self, part: int) -> dict:
        codes, marks, turns, roles, texts = self.values()
        span = _span(turns) or (None, None, None)
        row = {"conv": self.conv, "conv_id": self.conv_id, "part": part, "idx": self.written, "whole": False, "roles": roles, "texts": texts, "codes": codes.tobytes(), "marks": marks.tobytes(), "t_min": span[0], "t_max": span[1], "t_n": span[2]}
        self.frames, self.rows, self.chars, self.written = [], 0, 0, self.written + 1
        return row


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in NAMES})


def _whole(held: list[_Held], part: int) -> list[dict]:
    values = [h.values() for h in held]
    found = judged([v[0] for v in values], [v[1] for v in values], [[_span(v[2])] for v in values])
    rows = []
    for h, v, (plan, *figures) in zip(held, values, found, strict=True):
        roles, texts = rendered(plan, v[3], v[4])
        rows.append({"conv": h.conv, "conv_id": h.conv_id, "part": part, "idx": 0, "whole": True, "n_pieces": 1, "audit": letters(plan), "roles": roles, "texts": texts} | dict(zip(NAMES[-6:], figures, strict=True)))
    return rows


def _stream(frames: Iterator[pd.DataFrame], batch_rows: int, batch_chars: int) -> Iterator[pd.DataFrame]:
    """Sorted rows to whole conversations and pieces."""
    part, current, ready, first = TaskContext.get().partitionId(), None, [], True
    rows = chars = 0
    for pdf in frames:
        if not len(pdf):
            continue
        conv = pdf["conv"].to_numpy(object)
        cuts = sorted({0, *(np.flatnonzero(conv[1:] != conv[:-1]) + 1).tolist(), *range(0, len(pdf), batch_rows), len(pdf)})
        for a, b in zip(cuts, cuts[1:], strict=False):
            if current is not None and current.conv != conv[a]:
                if first or current.written:  # it may have begun in the partition before, or has pieces
                    if current.rows:
                        yield _frame([current.piece(part)])
                else:
                    ready.append(current)
                    rows, chars = rows + current.rows, chars + current.chars
                current, first = None, False
            if current is None:
                current = _Held(conv[a], pdf["conv_id"].iloc[a])
            current.add(pdf.iloc[a:b])
            if current.rows >= batch_rows or current.chars >= batch_chars:
                yield _frame([current.piece(part)])
            if rows >= batch_rows or chars >= batch_chars:
                yield _frame(_whole(ready, part))
                ready, rows, chars = [], 0, 0
    if ready:
        yield _frame(_whole(ready, part))
    if current is not None and current.rows:
        yield _frame([current.piece(part)])  # it may go on in the next partition


def _planned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces (conv, part, idx, codes, marks, t_min, t_max, t_n), sorted, to their edits and their conversation's figures."""

    def done(held: list[dict]) -> pd.DataFrame:
        codes = np.frombuffer(b"".join(r["codes"] for r in held), np.uint8)
        marks = np.frombuffer(b"".join(r["marks"] for r in held), "<u8").reshape(-1, 2)
        spans = [None if pd.isna(r["t_min"]) else (int(r["t_min"]), int(r["t_max"]), int(r["t_n"])) for r in held]
        (plan, *figures), at, rows = judged([codes], [marks], [spans])[0], 0, []
        for i, r in enumerate(held):
            upto = at + len(r["codes"]) if i < len(held) - 1 else len(plan)
            rows.append((r["conv"], r["part"], r["idx"], plan[at:upto].tobytes(), len(held), *figures))
            at = upto
        return pd.DataFrame(rows, columns=["conv", "part", "idx", "plan", "n_pieces", *NAMES[-6:]])

    held: list[dict] = []
    for pdf in frames:
        for r in pdf.to_dict("records"):
            if held and held[0]["conv"] != r["conv"]:
                yield done(held)
                held = []
            held.append(r)
    if held:
        yield done(held)


def _rendered_pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = []
        for r in pdf.to_dict("records"):
            plan = np.frombuffer(r["plan"], np.uint8).reshape(-1, 3)
            roles, texts = rendered(plan, list(r["roles"]), list(r["texts"]))
            rows.append(r | {"audit": letters(plan), "roles": roles, "texts": texts})
        if rows:
            yield _frame(rows)


def repair(rows: DataFrame, batch_rows: int = BATCH_ROWS, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """Repaired conversations of rows (conv_id, turn, role, text): one row for each, or several, in order of part and idx, for one that was cut.

    conv_id, part, idx, whole (it is the only one), audit (letters of the edits), roles and
    texts of the repaired turns, and the conversation's figures: gaps, blank, duplicate,
    truncated, illegal, cost.
    """
    plain = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    kind = plain.schema["conv_id"].dataType.simpleString()
    
    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _stream(frames, batch_rows, batch_chars)

    found = saved(_sorted_rows(plain).mapInPandas(stream, OUT.format(kind=kind)), "turns")
    pieces = found.where("not whole")
    sorted_pieces = pieces.select("conv", "part", "idx", "codes", "marks", "t_min", "t_max", "t_n").repartition("conv").sortWithinPartitions("conv", "part", "idx")
    plans = saved(sorted_pieces.mapInPandas(_planned, "conv string, part int, idx long, plan binary, n_pieces long, " + FIGURES), "edits")
    joined = pieces.drop("n_pieces", *NAMES[-6:]).join(plans, ["conv", "part", "idx"])
    mended = joined.select("plan", *NAMES).mapInPandas(_rendered_pieces, OUT.format(kind=kind))
    keep = ["conv", "conv_id", "part", "idx", "whole", "n_pieces", "audit", "roles", "texts", *NAMES[-6:]]
    every = found.where("whole").select(*keep).unionByName(mended.select(*keep))
    return every.withColumn("whole", F.col("n_pieces") == 1)


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations with the faults that a hash of conversation and turn gives them."""
    space = F.lit(" ")
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(key.cast("binary")) % 20
    rows = rows.withColumn("fault", fault).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("time")).drop("time")


def digests(repaired: DataFrame) -> DataFrame:
    """conv, audit, sha (of role:text, joined by newlines) and figures of each conversation; those in pieces are hashed as they stream by in order."""
    lines = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t))
    names = ["conv", "conv_id", *NAMES[-6:], "audit", "sha"]
    kind = repaired.schema["conv_id"].dataType.simpleString()
    whole = repaired.where("whole").withColumn("sha", F.sha2(F.array_join(lines, "\n"), 256)).select(*names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, row, audit, sha, begun = None, None, [], None, False

        def end() -> pd.DataFrame:
            return pd.DataFrame([[*row, "".join(audit), sha.hexdigest()]], columns=names).astype({"conv_id": object})

        for pdf in frames:
            for r in pdf.itertuples(index=False):
                if row is None or r.conv != conv:
                    if row is not None:
                        yield end()
                    conv, row, audit, sha, begun = r.conv, [getattr(r, n) for n in names[:-2]], [], hashlib.sha256(), False
                audit.append(r.audit)
                for role, text in zip(r.roles, r.texts, strict=True):
                    sha.update(("\n" if begun else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                    begun = True
        if row is not None:
            yield end()

    rest = repaired.where("not whole").repartition("conv").sortWithinPartitions("conv", "part", "idx").select(*names[:-1], "roles", "texts")
    cut = rest.mapInPandas(run, f"conv string, conv_id {kind}, {FIGURES}, audit string, sha string")
    return whole.unionByName(cut)


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = digests(repair(damaged(rows))).drop("conv_id")
    conv = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    ids = rows.select("conv_id").distinct().withColumn("of", conv)
    joined = ids.join(found, F.col("of") == F.col("conv"), "left")
    figures = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in NAMES[-6:]]
    return joined.select("conv_id", *figures, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


#: Each row's fault by CRC-32 (its table made bit by bit), then the cheapest and ASCII-least edits from the first row on, kept for each of the four states.
OP13_SQL = r"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hashed AS (SELECT given.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS f FROM given, crc),
damaged AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE f WHEN 3 THEN [0, 1] ELSE [0] END) AS time FROM hashed WHERE f <> 0),
placed AS (SELECT conv_id, turn, role, text, row_number() OVER w AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, time) AS nth, rtrim(text, E' \t\n\x0b\x0c\r') AS e FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, time)),
r AS MATERIALIZED (SELECT *, e = '' AS blank, e <> '' AND nth > 1 AS again, e <> '' AND nth = 1 AND right(e, 1) NOT IN ('.', '!', '?') AS cut, left(role, 1) AS i,
  n > 1 AND left(lag(role) OVER w, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY n)),
step(conv_id, n, z, s, u, a) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), {'c': CAST(0 AS BIGINT), 'e': '', 't': CAST([] AS VARCHAR[])}, {'c': CAST(1000000000 AS BIGINT), 'e': '', 't': CAST([] AS VARCHAR[])}, {'c': CAST(2 AS BIGINT), 'e': 'I', 't': ['user:']}, {'c': CAST(4 AS BIGINT), 'e': 'II', 't': ['user:', 'assistant:']} FROM r
  UNION ALL
  SELECT conv_id, n, z, s, least(u, {'c': a.c + 2, 'e': a.e || 'I', 't': list_append(a.t, 'user:')}, {'c': s.c + 2, 'e': s.e || 'I', 't': list_append(s.t, 'user:')}, {'c': z.c + 2, 'e': z.e || 'I', 't': list_append(z.t, 'user:')}),
    least(a, {'c': u.c + 2, 'e': u.e || 'I', 't': list_append(u.t, 'assistant:')}, {'c': s.c + 4, 'e': s.e || 'II', 't': s.t || ['user:', 'assistant:']}, {'c': z.c + 4, 'e': z.e || 'II', 't': z.t || ['user:', 'assistant:']}) FROM (
    SELECT conv_id, n, {'c': z.c + 3, 'e': z.e || 'D', 't': z.t} AS z,
      least({'c': s.c + 3, 'e': s.e || 'D', 't': s.t}, {'c': z.c + x + CASE WHEN i = 's' THEN 0 ELSE 1000000000 END, 'e': z.e || 'K', 't': list_append(z.t, line)}) AS s,
      least({'c': u.c + 3, 'e': u.e || 'D', 't': u.t}, {'c': z.c + x + k, 'e': z.e || h, 't': list_append(z.t, o)}, {'c': s.c + x + k, 'e': s.e || h, 't': list_append(s.t, o)}, {'c': a.c + x + k, 'e': a.e || h, 't': list_append(a.t, o)}) AS u,
      least({'c': a.c + 3, 'e': a.e || 'D', 't': a.t}, {'c': u.c + x + CASE WHEN i = 'a' THEN 0 ELSE 2 END, 'e': u.e || CASE WHEN i = 'a' THEN 'K' ELSE 'R' END, 't': list_append(u.t, CASE WHEN i = 'a' THEN line ELSE 'assistant:' || text END)}) AS a
    FROM (SELECT step.*, r.n AS rn, i, text, role || ':' || text AS line, CASE WHEN blank OR again THEN 1000000000 WHEN cut THEN 1 ELSE 0 END AS x, CASE WHEN i = 'u' THEN 0 ELSE 2 END AS k, CASE WHEN i = 'u' THEN 'K' ELSE 'R' END AS h, CASE WHEN i = 'u' THEN role || ':' || text ELSE 'user:' || text END AS o
      FROM step JOIN r ON r.conv_id IS NOT DISTINCT FROM step.conv_id AND r.n = step.n + 1) q(conv_id, n0, z, s, u, a, n, i, text, line, x, k, h, o))),
figures AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again) AS duplicate, count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE illegal) AS illegal FROM r GROUP BY conv_id),
best AS (SELECT f.*, least(z, a) AS w FROM figures f JOIN step ON step.conv_id IS NOT DISTINCT FROM f.conv_id AND step.n = f.rows),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(w.c, 0) AS cost, coalesce(w.e, '') AS audit, sha256(coalesce(array_to_string(w.t, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id"""
