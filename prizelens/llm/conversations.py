"""Conversation repair: the cheapest edits that bring turns into ``(s?(ua)+)?``.

Rows are repartitioned by conversation and sorted by turn from the last to the first, so
that one backward dynamic program streams over them: its state is the cost to go of four
places in the pattern, carried from one Arrow batch to the next, and each row leaves one
byte of backpointers (two bits a place). When a conversation's first row has gone by, the
bytes are walked forward. Deciding forward by the least letter among the cheapest edits
gives the ASCII-least of all cheapest edit scripts, since a letter determines the next
place. A giant conversation's rows and bytes go to the shared folder in chunks beyond a
budget, so memory does not grow with it (its audit, one letter a row, is part of the result).

A conversation is one stream in one task by nature of the method. Duplicates are found by a
window that reuses the same partitioning, so texts are shuffled once.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prizelens.llm.common import WORD
from prizelens.llm.files import shared_file
from prizelens.session import new_run_dir

SPOOL_BYTES = 32 << 20  # a conversation beyond this goes to the shared folder in chunks
BATCH_ROWS = 4096

# Places in the pattern: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
PLACES = (START, SYSTEM, USER, ASSISTANT)
# Where a kept role leads from each place; whatever is not listed breaks the pattern.
KEPT = {
    (START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER,
    (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER,
}
# The one role that an inserted or reroled turn can take there, and where it leads.
FREE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LETTERS = "DIKR"  # in ASCII order

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
AUDIT = "conv string, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
TURNS = "conv string, position long, turn string, role string, text string, edit string"


def at_end() -> tuple[tuple[int, ...], int]:
    """Cost to go behind the last row, and its pointers: an open pair is closed by inserts."""
    return (0, 4, 2, 0), sum(LETTERS.index("I") << 2 * q for q in (SYSTEM, USER))


def step(ahead: tuple[int, ...], kind: tuple[bool, str, bool]) -> tuple[tuple[int, ...], int]:
    """Costs before a row from those after it, and the row's byte of choices.

    ``kind``: whether the row must go, its role initial, whether it is cut off.
    """
    must_go, initial, cut_off = kind
    options = []
    for q in PLACES:
        own = {"D": 3 + ahead[q]}
        if not must_go:
            own["R"] = 2 + cut_off + ahead[FREE[q]]
            if (q, initial) in KEPT:
                own["K"] = cut_off + ahead[KEPT[q, initial]]
        options.append(own)
    base = [min(own.values()) for own in options]
    # Inserts before the row: user and assistant alternate, so one round each settles them.
    cost = list(base)
    cost[USER] = min(base[USER], 2 + base[ASSISTANT])
    cost[ASSISTANT] = min(base[ASSISTANT], 2 + base[USER])
    byte = 0
    for q in PLACES:
        options[q]["I"] = 2 + cost[FREE[q]]
        cost[q] = min(cost[q], options[q]["I"])
        letter = min(x for x, c in options[q].items() if c == cost[q])
        byte |= LETTERS.index(letter) << 2 * q
    return tuple(cost), byte


class Steps(dict):
    """``step`` by heart: costs less their least value take few forms."""

    def __missing__(self, key):
        ahead, kind = key
        cost, byte = step(ahead, kind)
        least = min(cost)
        out = self[key] = (tuple(c - least for c in cost), least, byte)
        return out


class Spool:
    """Rows with their bytes, written last row first and read first row first."""

    def __init__(self, folder: str, budget: int):
        self.folder, self.budget = folder, budget
        self.rows, self.size, self.files = [], 0, []

    def add(self, turn: str | None, role: str, text: str, byte: int) -> None:
        self.rows.append((turn, role, text, byte))
        self.size += 4 * len(text) + 200
        if self.size > self.budget:
            system, base = shared_file(self.folder)
            system.create_dir(base, recursive=True)
            name = f"{base}/turns-{uuid.uuid4().hex}"
            with system.open_output_stream(name, compression=None) as out:
                out.write(pickle.dumps(self.rows))
            self.files.append(name)
            self.rows, self.size = [], 0

    def read(self) -> Iterator[tuple]:
        yield from reversed(self.rows)
        self.rows = []
        for name in reversed(self.files):
            system, _ = shared_file(self.folder)
            with system.open_input_stream(name, compression=None) as f:
                rows = pickle.loads(f.read())
            yield from reversed(rows)
            system.delete_file(name)


class Conversation:
    """One conversation as its rows go by, last row first."""

    def __init__(self, conv: str | None, folder: str, budget: int):
        self.conv = conv
        self.spool = Spool(folder, budget)
        self.rows = self.illegal = self.distinct = self.base = 0
        self.faults = [0, 0, 0, 0]
        self.first = self.last = self.turn = self.after = None
        self.ahead, self.end = at_end()

    def add(self, steps: Steps, turn: str | None, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        if self.rows:
            self.illegal += initial + self.after not in ("su", "ua", "au")
        self.rows += 1
        self.after = initial
        if turn is not None and (self.turn is None or turn != self.turn):
            self.distinct += 1
            self.first, self.turn = int(turn), turn
            self.last = self.first if self.last is None else self.last
        self.faults[fault] += 1
        kind = (fault in (1, 2), initial, fault == 3)
        self.ahead, least, byte = steps[self.ahead, kind]
        self.base += least
        self.spool.add(turn, role, text, byte)

    def edits(self) -> Iterator[tuple]:
        """``letter, turn, role, text`` in order of turns; a deleted row has its own role."""
        place = START
        for turn, role, text, byte in self.spool.read():
            while (letter := LETTERS[byte >> 2 * place & 3]) == "I":
                place = FREE[place]
                yield "I", None, ROLE[place], ""
            if letter == "K":
                place = KEPT[place, role[:1]]
            elif letter == "R":
                place = FREE[place]
                role = ROLE[place]
            yield letter, turn, role, text
        while LETTERS[self.end >> 2 * place & 3] == "I":
            place = FREE[place]
            yield "I", None, ROLE[place], ""

    def counts(self) -> list[int]:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return [gaps, *self.faults[1:], self.illegal, self.base + self.ahead[START]]


def conversations(batches: Iterator[pd.DataFrame], folder: str, budget: int) -> Iterator[Conversation]:
    """The conversations of a sorted stream of rows, one at a time."""
    steps, now = Steps(), None
    for batch in batches:
        for conv, turn, role, text, fault in zip(*(batch[c].to_list() for c in batch.columns)):
            if now is None or conv != now.conv:
                if now is not None:
                    yield now
                now = Conversation(conv, folder, budget)
            if fault >= 0:
                now.add(steps, turn, role, text, fault)
    if now is not None:
        yield now


def audits(folder: str, budget: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for c in conversations(batches, folder, budget):
            letters, digest, started = bytearray(), hashlib.sha256(), False
            for letter, _, role, text in c.edits():
                letters += letter.encode()
                if letter != "D":
                    digest.update(f"{chr(10) if started else ''}{role}:{text}".encode())
                    started = True
            out.append([c.conv, *c.counts(), letters.decode(), digest.hexdigest()])
            if len(out) == BATCH_ROWS or len(letters) > 1 << 20:
                yield pd.DataFrame(out, columns=["conv", *COUNTS, "audit", "repaired_sha256"])
                out = []
        yield pd.DataFrame(out, columns=["conv", *COUNTS, "audit", "repaired_sha256"])

    return run


def turns(folder: str, budget: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv", "position", "turn", "role", "text", "edit"]
        out, size = [], 0
        for c in conversations(batches, folder, budget):
            position = 0
            for letter, turn, role, text in c.edits():
                if letter != "D":
                    out.append((c.conv, position, turn, role, text, letter))
                    position += 1
                    size += len(text) + 100
                if size > SPOOL_BYTES:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
        yield pd.DataFrame(out, columns=names)

    return run


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn",
            role: str = "role", text: str = "text") -> DataFrame:
    """Rows as ``conv, turn, role, text, gone`` with a fault that CRC-32 of ``conv:turn``
    deals to every fourth: dropped (kept as a row that is ``gone``), emptied, without marks
    of an end, repeated, or role user. Nulls read as one space, but for the turn itself."""

    def plain(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    out = rows.select(
        F.col(conv).cast("string").alias("conv"), F.col(turn).cast("string").alias("turn"),
        plain(role).alias("role"), plain(text).alias("text"),
        (F.crc32(F.concat(plain(conv), F.lit(":"), plain(turn))) % 20).alias("_f"),
    )
    f = F.col("_f")
    return out.select(
        "conv", "turn",
        F.when(f == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(f == 1, "").when(f == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        (f == 0).alias("gone"),
        F.explode(F.when(f == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_n"),
    ).drop("_n")


def sorted_turns(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, text, fault`` by conversation, last row first.

    Fault: -1 gone, 0 none, 1 blank, 2 duplicate, 3 truncated; a row's first one counts.
    Rows of one turn are ordered by role and text, null turns come first.
    """
    number = F.col("turn").cast("decimal(38,0)")
    rows = rows.withColumn("_t", number).repartition("conv")
    # Same partitioning, so the window sorts without another shuffle.
    same = Window.partitionBy("conv", "gone", "role", "text").orderBy(F.col("_t").asc_nulls_first())
    marked = rows.withColumn("_again", F.row_number().over(same) > 1)
    fault = (
        F.when(F.col("gone"), -1)
        .when(~F.rlike("text", F.lit(WORD)), 1)
        .when(F.col("_again"), 2)
        .when(~F.rlike("text", F.lit("[.!?][\\x20\\x09-\\x0D]*\\z")), 3)
        .otherwise(0)
    )
    return (
        marked.withColumn("fault", fault)
        .sortWithinPartitions(
            "conv", F.col("_t").desc_nulls_last(), F.desc("role"), F.desc("text"), F.desc("_again")
        )
        .select("conv", "turn", "role", "text", "fault")
    )


def repair_audit(rows: DataFrame, budget: int = SPOOL_BYTES) -> DataFrame:
    """One row per conversation: faults, cost of the cheapest repair, its letters (Delete,
    Insert, Keep, Rerole) and the SHA-256 of the repaired ``role:text`` lines.

    ``rows``: ``conv, turn, role, text, gone`` as ``damaged`` gives them (turn a whole number
    as text); other columns are not read. A null conversation is one of its own; null turns come
    first and do not count for gaps; a conversation whose rows are all gone has zeros, no
    letters and the hash of nothing; an empty table gives no rows. Repeated rows are duplicates.
    A role other than system, user and assistant goes by its first letter; without one it can
    only be reroled or deleted.
    """
    folder = new_run_dir(rows.sparkSession, "turns")
    return sorted_turns(rows).mapInPandas(audits(folder, budget), AUDIT)


def repaired_turns(rows: DataFrame, budget: int = SPOOL_BYTES) -> DataFrame:
    """The repaired conversations as rows, with each turn's position and edit; rows in
    and their odd cases as for ``repair_audit``. Inserted turns have a null turn."""
    folder = new_run_dir(rows.sparkSession, "turns")
    return sorted_turns(rows).mapInPandas(turns(folder, budget), TURNS)
