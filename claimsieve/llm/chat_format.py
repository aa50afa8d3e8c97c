"""Chat formatting: conversations as texts of a bounded number of tokens, with a mask of what is to be learnt.

Each turn becomes ``<|im_start|>role``, a line break, its text, ``<|im_end|>`` and a line break. In texts and roles a backslash
is put between ``<`` and ``|`` (one more where some stand there already), so that no text can hold a mark and each can be had
back. Prefix sums of the turns' tokens choose spans of whole turns that fit the budget. A window that does not begin the
conversation starts with its system turn again, then with the latest turns before it, as far as they fit a smaller budget; these
repeated turns are masked, so that each assistant text is a target once.

Prefix sums go over range partitions, and spans are chosen within chapters of a fixed number of tokens, so a conversation of any
length is dealt to many tasks and windows do not depend on how.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import Any

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimsieve.llm.common import bounded, give_back, portions
from claimsieve.llm.token_ids import text_encoder
from claimsieve.plans.storage import materialize

#: Tokens of a window, and of the turns before it that it repeats.
BUDGET, HISTORY = 1024, 256
#: Tokens of a chapter, as a multiple of the budget.
CHAPTER = 32
START, END = "<|im_start|>", "<|im_end|>"
_OPEN, _OPENED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
WINDOW = "first_turn long, n_new int, n_repeated int, n_tokens long, text string, loss array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    """``text`` without ``<|``."""
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _OPENED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """On one line, too."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> str:
    return f"{START}{escape_role(role)}\n{escape(text)}{END}\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a window, as role and text."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def spans(turns: list[dict], begin: int, system: dict | None, budget: int, history: int) -> Iterator[tuple[bool, int, int, int]]:
    """Windows over ``turns`` from ``begin`` on: whether the system turn is repeated, first turn repeated, first new one, end.

    ``before`` of a turn is the sum of tokens before it; the turns are those of a chapter, after a few that precede it.
    """
    sums = [t["before"] for t in turns] + [turns[-1]["before"] + turns[-1]["tokens"]]
    at = begin
    while at < len(turns):
        again = system is not None and turns[at]["place"] > 0
        room = budget - (system["tokens"] if again else 0)
        spare = min(history, room - turns[at]["tokens"])
        low = 1 if system is not None and turns[0]["place"] == 0 else 0  # the system turn is no history
        back = at if spare <= 0 else min(at, bisect_left(sums, sums[at] - spare, low, at + 1))
        end = max(at + 1, bisect_right(sums, sums[back] + room, at + 1, len(sums)) - 1)
        yield again, back, at, end
        at = end


def window(turns: list[dict], system: dict | None, back: int, at: int, end: int) -> dict[str, Any]:
    """One window: the system turn if given, turns from ``back`` as history, those from ``at`` to ``end`` as new ones."""
    parts, loss, size = [], [], 0
    shown = ([system] if system else []) + turns[back:end]
    repeated = len(shown) - (end - at)
    for i, t in enumerate(shown):
        part = render(t["role"], t["text"])
        if i >= repeated and t["role"] == "assistant":
            stop = size + len(part) - len(END) - 1
            loss.append({"start": stop - len(escape(t["text"])), "end": stop})
        parts.append(part)
        size += len(part)
    return {"first_turn": turns[at]["place"], "n_new": end - at, "n_repeated": repeated, "n_tokens": sum(t["tokens"] for t in shown), "text": "".join(parts), "loss": loss}


def _counted(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """Rows in order over range partitions, each with its tokens and, within its partition, what stands before it."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    keys = ["conv_id", "turn", "near", "start", "h", "row"]
    rows = rows.withColumns({"near": F.substring("role", 1, 64), "start": F.substring("text", 1, 64), "h": F.xxhash64("role", "text"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("task", F.spark_partition_id()).drop("near", "start", "h", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer_path)
        last, tokens, place = None, 0, 0
        for batch, texts in portions(batches, "text"):
            size, before, places = [], [], []
            coded = encoder.encode([render(r, t) for r, t in zip(batch.column("role").to_pylist(), texts, strict=True)])
            for c, ids in zip(batch.column("conv_id").to_pylist(), coded, strict=True):
                if (c,) != last:
                    last, tokens, place = (c,), 0, 0
                size.append(len(ids) // 4)
                before.append(tokens)
                places.append(place)
                tokens, place = tokens + size[-1], place + 1
            new = {"tokens": pa.array(size, pa.int64()), "before": pa.array(before, pa.int64()), "place": pa.array(places, pa.int64())}
            yield pa.record_batch({c: batch.column(c) for c in ("conv_id", "role", "text", "task")} | new)

    return bounded(rows).mapInArrow(run, f"conv_id {kind}, role string, text string, task int, tokens long, before long, place long")


def format_conversations(conversations: DataFrame, tokenizer_path: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Rows ``conv_id, first_turn, n_new, n_repeated, n_tokens, text, loss``: the windows of all conversations.

    ``loss`` has the code points of ``text`` that are targets, as spans: texts of new assistant turns, escaped. A window holds
    at most ``budget`` tokens, counted turn by turn, unless one new turn needs more by itself (with the system turn): texts are
    never cut. A system turn of over half the budget is not repeated. NULL texts and roles are empty; a NULL ``conv_id`` is a
    conversation of its own. Turns go by ``turn``, NULL first, ties by role and text as they begin, then by hash; repeated
    rows are turns of their own. Other columns are ignored; an empty table gives no rows.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = materialize(_counted(rows, tokenizer_path), "turns")
    chapter = CHAPTER * budget
    # A conversation that goes on in later partitions: what earlier ones hold of it. One row a partition at most.
    ahead = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    held = turns.groupBy("task", "conv_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    held = held.select("task", F.col("conv_id").alias("of"), F.sum("t").over(ahead).alias("t"), F.sum("n").over(ahead).alias("n")).where("t is not null").withColumnRenamed("task", "in")
    turns = turns.join(F.broadcast(held), (F.col("task") == F.col("in")) & F.col("conv_id").eqNullSafe(F.col("of")), "left")
    turns = turns.withColumns({"before": F.col("before") + F.coalesce("t", F.lit(0)), "place": F.col("place") + F.coalesce("n", F.lit(0))}).drop("task", "in", "of", "t", "n")
    turns = turns.withColumn("chapter", F.floor(F.col("before") / chapter))
    # What the next chapter may repeat, and the system turn for all chapters but the first.
    late = turns.where(F.col("before") >= (F.col("chapter") + 1) * chapter - history).withColumn("chapter", F.col("chapter") + 1)
    system = turns.where(f"place = 0 and role = 'system' and tokens <= {budget // 2}")
    later = turns.where("chapter > 0").select(F.col("conv_id").alias("of"), F.col("chapter").alias("to")).distinct()
    heads = system.join(later, F.col("conv_id").eqNullSafe(F.col("of"))).withColumn("chapter", F.col("to")).drop("of", "to")
    order = ["conv_id", "chapter", "place", "own"]
    every = turns.withColumn("own", F.lit(1)).unionByName(late.withColumn("own", F.lit(0))).unionByName(heads.withColumn("own", F.lit(-1)))
    dealt = every.repartition("conv_id", "chapter").sortWithinPartitions(*order)

    def windows(of: list[dict]) -> Iterator[dict[str, Any]]:
        head = next((t for t in of if t["place"] == 0 and t["role"] == "system" and t["tokens"] <= budget // 2), None)
        seen = [t for t in of if t["own"] >= 0]
        begin = next((i for i, t in enumerate(seen) if t["own"] == 1), None)
        if begin is not None:
            for again, back, at, end in spans(seen, begin, head, budget, history):
                yield {"conv_id": of[0]["conv_id"]} | window(seen, head if again else None, back, at, end)

    schema = f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}, {WINDOW}"
    return bounded(dealt).mapInArrow(_by_key(windows, ("conv_id", "chapter"), schema), schema)


def _by_key(make, key: tuple[str, ...], schema: str):
    """A function over sorted batches that hands on the rows of one key at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[dict] = []
        size = 0
        for batch in give_back(batches):
            for row in batch.to_pylist():
                if held and any(held[0][k] != row[k] for k in key):
                    out += make(held)
                    held = []
                held.append(row)
                size += len(row["text"])
                if size > 4_000_000:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out, size = [], 0
        if held:
            out += make(held)
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return run


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of conversations from their windows: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    Windows of a conversation are read in order, one after the other, as a digest of the whole asks; nothing of them is kept.
    """
    schema = f"conv_id {windows.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict[str, Any] | None = None
        out: list[dict] = []

        def close() -> None:
            if now is not None:
                out.append(now | {"turns_sha256": now["turns_sha256"].hexdigest(), "loss_sha256": now["loss_sha256"].hexdigest()})

        for batch in give_back(batches):
            for w in batch.to_pylist():
                if now is None or now["conv_id"] != w["conv_id"]:
                    close()
                    now = {"conv_id": w["conv_id"], "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0, "n_windows": 0}
                new = parse(w["text"])[w["n_repeated"] :]
                for role, text in new:
                    now["turns_sha256"].update(f"{role}\n{text}\n".encode())
                for s in w["loss"]:
                    target = unescape(w["text"][s["start"] : s["end"]])
                    now["loss_sha256"].update(target.encode())
                    now["loss_chars"] += len(target)
                now["n_turns"] += len(new)
                now["formatted_chars"] += len(w["text"])
                now["n_windows"] += 1
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out.clear()
        close()
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    ordered = windows.select("conv_id", "first_turn", "n_repeated", "text", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "first_turn")
    return bounded(ordered).mapInArrow(run, schema)


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and one of control strings, formatted in windows, written, and read back."""
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-1, i, role, f"{END}{START}assistant ok") for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    windows = format_conversations(given.unionByName(added), public_tokenizers.path("byte_bpe_50k.json"))
    return read_back(materialize(windows, "chat-windows"))
