"""Structure repair of conversations: cheapest edits by an automaton of role and fault signatures that share their ends."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from math import inf
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch
from tessera.llm.skew import join_named

#: Rows of a segment: as many consecutive rows make a signature; longer conversations are put together from segments.
SEGMENT_BITS = 8
#: So many neighbouring segments, as a power of two, are put together at a time.
FAN_BITS = 6
#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: Grammar states: nothing yet, after a system, a user, an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State -> state after a user or an assistant row, whichever may follow; the other one may not.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_KEEP = {(START, "s"): SYSTEM} | {(s, "u" if t == USER else "a"): t for s, t in _NEXT.items()}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Ends of a signature: that of the conversation (an empty or whole one is accepted), or of a segment in a given state.
ENDS = 5
Node = list[list[tuple[float, str]]]


def _inserted(best: list[tuple[float, str]]) -> list[tuple[float, str]]:
    """Best ways from each state when empty rows may come first: two at most, as more return to a state."""
    for _ in range(2):
        best = [min(b, (best[_NEXT[s]][0] + INSERT, "I" + best[_NEXT[s]][1])) for s, b in enumerate(best)]
    return best


def _last() -> Node:
    """The node of the empty suffix: [end][state] -> (cost to go, least audit of that cost)."""
    whole = _inserted([(0, ""), (inf, ""), (inf, ""), (0, "")])
    return [whole, *([(0, "") if s == e else (inf, "") for s in range(4)] for e in range(4))]


def _before(symbol: str, rest: Node) -> Node:
    """The node of a suffix that starts with ``symbol``: s, u, a or x by the role, capital if truncated, d if it must go."""
    role, extra = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    node = []
    for ways in rest:
        best = []
        for state in range(4):
            choice = [(ways[state][0] + DELETE, "D" + ways[state][1])]
            if role != "d":
                after = ways[_NEXT[state]]
                choice.append((after[0] + REROLE + extra, "R" + after[1]))
                if (state, role) in _KEEP:
                    after = ways[_KEEP[state, role]]
                    choice.append((after[0] + extra, "K" + after[1]))
            best.append(min(choice))
        node.append(_inserted(best))
    return node


class Automaton:
    """Nodes of the suffixes of signatures that come in order of their reversed strings: each suffix is made once."""

    def __init__(self):
        self.symbols, self.nodes = "", [_last()]

    def node(self, signature: str) -> Node:
        wanted, shared = signature[::-1], 0
        while shared < min(len(wanted), len(self.symbols)) and wanted[shared] == self.symbols[shared]:
            shared += 1
        del self.nodes[shared + 1 :]
        for symbol in wanted[shared:]:
            self.nodes.append(_before(symbol, self.nodes[-1]))
        self.symbols = wanted
        return self.nodes[-1]


def _joined(first: Node, then: Node) -> Node:
    """The node of two signatures, one after the other.

    Ways of the first one that end in one state at one cost never start with each other, so the least of each is enough.
    """
    through = first[1:]
    return [
        [min((through[e][s][0] + ways[e][0], through[e][s][1] + ways[e][1]) if through[e][s][0] + ways[e][0] < inf else (inf, "") for e in range(4)) for s in range(4)]
        for ways in then
    ]


_WAYS = "array<struct<cost:bigint,audit:string>>"


def _flat(node: Node) -> list[dict]:
    return [{"cost": None if cost == inf else cost, "audit": None if cost == inf else audit} for ways in node for cost, audit in ways]


def _folded(flat: list[dict]) -> Node:
    ways = [(inf, "") if w["cost"] is None else (w["cost"], w["audit"]) for w in flat]
    return [ways[k : k + 4] for k in range(0, 4 * ENDS, 4)]


_ARROW_WAYS = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton()
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            names = batch.column(0).slice(at, 64)
            yield pa.RecordBatch.from_arrays([names, pa.array([_flat(automaton.node(s)) for s in names.to_pylist()], _ARROW_WAYS)], ["signature", "ways"])


def _illegal(roles: Column) -> Column:
    """Adjacent role initials that aren't su, ua or au."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(roles) - 1), lambda i: F.substring(roles, i, F.lit(2)))
    return F.when(F.length(roles) < 2, 0).otherwise(F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))).cast("bigint")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from batch.slice(at, 256).to_pylist()


def _put_together(kind: pa.DataType):
    """Neighbouring parts, in order, of one conversation and group -> one part."""
    names = ["conv", "part", "first", "last", "illegal", "ways"]
    kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.int64(), _ARROW_WAYS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, group), found in groupby(_rows(batches), key=itemgetter("conv", "group")):
            parts = list(found)  # as many as FAN_BITS allows
            node, first, illegal = _folded(parts[-1]["ways"]), parts[-1]["first"], parts[-1]["illegal"]
            for part in reversed(parts[:-1]):
                node = _joined(_folded(part["ways"]), node)
                illegal += part["illegal"] + (part["last"] + first not in ("su", "ua", "au"))
                first = part["first"]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((conv, group, first, parts[-1]["last"], illegal, _flat(node)), kinds, strict=True)], names)

    return run


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows (conv, pos, role, text, audit), of which the first of a conversation carries its audit -> (conv, role, text) after the edits; (conv, None, None) ends a conversation."""
    for conv, rows in groupby(_rows(batches), key=itemgetter("conv")):
        audit, at, state = next(rows)["audit"], 0, START
        for row in rows:
            while audit[at] == "I":
                state, at = _NEXT[state], at + 1
                yield conv, _NAMES[state], ""
            edit, at = audit[at], at + 1
            if edit != "D":
                state = _KEEP[state, row["role"][:1]] if edit == "K" else _NEXT[state]
                yield conv, row["role"] if edit == "K" else _NAMES[state], row["text"]
        for _ in audit[at:]:
            state = _NEXT[state]
            yield conv, _NAMES[state], ""
        yield conv, None, None


def _hashes(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convs, found, now = [], [], None
        for conv, role, text in _edited(batches):
            if role is None:
                convs.append(conv)
                found.append((now or hashlib.sha256()).hexdigest())
                now = None
            else:
                line = f"{role}:{text}".encode()
                if now is None:
                    now = hashlib.sha256(line)
                else:
                    now.update(b"\n")
                    now.update(line)
            if len(convs) == 1024:
                yield pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(found)], ["conv", "sha"])
                convs, found = [], []
        yield pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(found, pa.string())], ["conv", "sha"])

    return run


def _turns(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place = [], 0
        for conv, role, text in _edited(batches):
            if role is None:
                place = 0
                continue
            out.append((conv, place, role, text))
            place += 1
            if len(out) == 256:
                yield _batch(out)
                out = []
        yield _batch(out)

    def _batch(out: list) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (kind, pa.int64(), pa.string(), pa.string()), strict=True)], ["conv", "place", "role", "text"])

    return run


class Repair:
    """Repairs of all conversations of a table.

    Rows of a conversation stand in order of turn (nulls first), role and text; a null role
    or text is one space. The first fault of a row counts: blank (nothing but
    ASCII white space), duplicate (role and text stood in an earlier row), truncated (the last
    character that is no white space isn't one of ``.!?``). A repaired conversation is
    empty or pairs of user and assistant rows, after one system row or none, told by the initials of roles.
    Keeping a row is free, another role costs 3, an inserted empty row 3, deleting 4, and 3 more a truncated
    row that stays; blank and duplicate rows go. Of the cheapest lists of edits (Keep, Rerole, Delete, Insert)
    that with the least initials is taken. A null id is a conversation like any other, and of
    repeated rows all but one are duplicates. Other columns are ignored; an empty table gives empty results.

    Positions come from a range sort, so a conversation of any length is dealt to many tasks; signatures are
    of segments of 256 rows at most, and segments are put together 64 at a time. Only a
    hash of the whole text has to be taken in one pass, which streams.
    """

    def __init__(self, rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"):
        self.scratch = Scratch(rows.sparkSession, "repair")
        self.id_col = id_col
        space = lambda c: F.coalesce(F.col(c), F.lit(" "))
        plain = rows.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
        order = ["conv", "turn", "role", "text"]
        # Rows alike in all columns may be many: they are told apart, so that they don't all go to one task.
        sort = plain.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(*order, "nth").sortWithinPartitions(*order, "nth").drop("nth")
        placed = self.scratch.keep(sort.withColumn("at", F.monotonically_increasing_id()), "placed")
        part = F.shiftright("at", 33)
        sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row per partition
        before, total = {}, 0
        for k, n in sizes:
            before[k], total = total, total + n
        offset = F.element_at(F.create_map(*(F.lit(x) for kn in before.items() for x in kn)), part) if before else F.lit(0)
        self.rows = placed.withColumn("pos", (F.col("at").bitwiseAND((1 << 33) - 1) + offset).cast("bigint")).drop("at")
        self.kind = pa.int64() if dict(rows.dtypes)[id_col] == "bigint" else self._arrow_type(rows.schema[id_col].dataType)

    @staticmethod
    def _arrow_type(kind):
        from pyspark.sql.pandas.types import to_arrow_type

        return to_arrow_type(kind)

    def faults(self) -> DataFrame:
        """(conv, turn, pos, initial, fault, symbol) of each row."""
        ids = self.rows.select("conv", "turn", "pos", F.substring("role", 1, 1).alias("initial"), F.expr("trim(TRAILING ' \t\n\x0b\f\r' FROM text)").alias("end"), F.xxhash64("role", "text").alias("h1"), F.xxhash64("text", F.lit(1), "role").alias("h2"))
        ids = self.scratch.keep(ids.select("conv", "turn", "pos", "initial", "h1", "h2", (F.col("end") == "").alias("blank"), (~F.substring("end", -1, 1).isin(".", "!", "?")).alias("open")), "ids")
        first = ids.groupBy("conv", "h1", "h2").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
        fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("open"), "truncated")
        told = ids.join(first, "pos", "left").select("conv", "turn", "pos", "initial", fault.alias("fault"))
        role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
        symbol = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(role)).otherwise(role)
        return self.scratch.keep(told.select("conv", "turn", "pos", role.alias("initial"), "fault", symbol.alias("symbol")), "faults")

    def audits(self) -> DataFrame:
        """One row per conversation: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit)."""
        faults = self.faults()
        counts = [F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")]
        gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps")
        told = self.scratch.keep(faults.groupBy("conv").agg(gaps), "gaps").join(self.scratch.keep(faults.groupBy(F.col("conv").alias("_conv")).agg(*counts), "counts"), F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")

        ordered = F.array_sort(F.collect_list(F.struct("pos", "initial", "symbol")))
        segments = faults.groupBy("conv", F.shiftright("pos", SEGMENT_BITS).alias("part")).agg(ordered.alias("rows"))
        roles = F.array_join("rows.initial", "")
        segments = segments.select("conv", "part", F.array_join("rows.symbol", "").alias("signature"), roles.alias("roles"))
        segments = self.scratch.keep(segments.select("conv", "part", "signature", F.substring("roles", 1, 1).alias("first"), F.substring("roles", -1, 1).alias("last"), _illegal(F.col("roles")).alias("illegal")), "segments")
        signatures = segments.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
        backwards = F.reverse("signature")
        nodes = self.scratch.keep(signatures.repartitionByRange(backwards).sortWithinPartitions(backwards).select("signature").mapInArrow(_nodes, f"signature string, ways {_WAYS}"), "nodes")
        counted = self.scratch.keep(nodes.join(signatures, "signature"), "counted")
        parts = self.scratch.keep(join_named(segments, counted, "signature", "n").drop("signature"), "parts-0")

        schema = parts.schema
        alone, done, k = None, [], 0
        while True:
            many = parts.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
            many = self.scratch.keep(many.where("n > 1").select(F.col("conv").alias("_conv")), f"many-{k}")
            same = F.col("conv").eqNullSafe(F.col("_conv"))
            done.append(parts.join(many, same, "left_anti"))
            if not many.limit(1).count():
                break
            grouped = parts.join(many, same, "left_semi").withColumn("group", F.shiftright("part", FAN_BITS))
            k += 1
            parts = self.scratch.keep(grouped.repartition("conv", "group").sortWithinPartitions("conv", "group", "part").drop("part").mapInArrow(_put_together(self.kind), schema), f"parts-{k}")
        alone = done[0]
        for frame in done[1:]:
            alone = alone.unionByName(frame)
        best = alone.select(F.col("conv").alias("_conv"), "illegal", F.col("ways")[START].alias("way"))
        joined = told.join(best, F.col("conv").eqNullSafe(F.col("_conv"))).select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("way.cost").alias("cost"), F.col("way.audit").alias("audit"))
        return self.scratch.keep(joined, "audits")

    def _with_audits(self, audits: DataFrame) -> DataFrame:
        heads = audits.select("conv", F.lit(-1).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
        rows = self.rows.select("conv", "pos", "role", "text", F.lit(None).cast("string").alias("audit"))
        return heads.unionByName(rows).repartition("conv").sortWithinPartitions("conv", "pos")

    def hashes(self, audits: DataFrame) -> DataFrame:
        """(conv, sha): SHA-256 of each conversation's repaired ``role:text`` rows, joined by line feeds."""
        schema = self.rows.select("conv").schema.add("sha", "string")
        return self._with_audits(audits).mapInArrow(_hashes(self.kind), schema)

    def turns(self) -> DataFrame:
        """The repaired conversations: (id, place, role, text), places from 0."""
        schema = self.rows.select("conv").schema.add("place", "long").add("role", "string").add("text", "string")
        return self._with_audits(self.audits()).mapInArrow(_turns(self.kind), schema).withColumnRenamed("conv", self.id_col)


def repair(rows: DataFrame, **columns: str) -> DataFrame:
    """One row per conversation of ``rows``: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), as ``Repair`` says.

    ``gaps`` are turns missing between the first and the last, nulls ignored; ``illegal`` counts adjacent rows whose
    role initials are not su, ua or au.
    """
    job = Repair(rows, **columns)
    audits = job.audits()
    hashes = job.scratch.keep(job.hashes(audits), "hashes")
    job.scratch.clear("audits", "hashes")
    found = audits.join(hashes.withColumnRenamed("conv", "_conv"), F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")
    return found.withColumnsRenamed({"conv": job.id_col, "sha": "repaired_sha256"})


def damage(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (id, turn, role, text) damaged by ``crc32(id:turn) % 20``, nulls a space: 0 drops a row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes it the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(id_col), F.lit(":"), space(turn_col))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space(text_col), ".!?", "")).otherwise(space(text_col))
    copies = F.explode(F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select(id_col, turn_col, F.when(kind == 4, "user").otherwise(space(role_col)).alias(role_col), text.alias(text_col), copies.alias("_copy")).drop("_copy")
