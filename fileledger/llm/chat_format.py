"""Chat formatting of typed content parts, with a loss mask and reversible escapes.

A message is an array of parts (kind, text, uri, amount).  A visitor turns each
kind into its rendered form: text is escaped and stays text, image, audio and
document parts become numbered placeholders whose references and expanded token
counts are recorded.  Everything up to the finished conversation is built from
column expressions.

Rules.  Null text or null parts: empty.  Null role: empty role.  Rows of one
conversation are ordered by turn (nulls first), then role, then rendered body;
rows equal in all of these are repeated as they are.  Rows with a null
conversation id form one conversation.  An empty table gives an empty table.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,uri:string,amount:double>"


def escape(c: Column) -> Column:
    """No `<`, `>` is left in what this gives, so a marker cannot come from a text."""
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(s: str) -> str:
    return s.replace("\\l", "<").replace("\\g", ">").replace("\\s", "\\") if "\\" in s else s


@dataclass(frozen=True)
class PartVisitor:
    """Rendered text and expanded token count by kind of part.  amount: pixels, seconds or pages."""

    pixels_per_token: float = 784.0
    tokens_per_second: float = 25.0
    tokens_per_page: float = 1024.0
    chars_per_token: float = 4.0

    def visit_text(self, part: Column) -> tuple[Column, Column]:
        text = F.coalesce(part["text"], F.lit(""))
        return escape(text), F.ceil(F.length(text) / self.chars_per_token)

    def visit_image(self, part: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.coalesce(part["amount"], F.lit(0.0)) / self.pixels_per_token))

    def visit_audio(self, part: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.coalesce(part["amount"], F.lit(0.0)) * self.tokens_per_second))

    def visit_document(self, part: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.coalesce(part["amount"], F.lit(0.0)) * self.tokens_per_page))

    def flatten(self, parts: Column) -> Column:
        """array<struct<kind, rendered, uri, tokens>> in the order of the parts; unknown kinds are kept as placeholders of 0 tokens."""

        def one(part: Column, i: Column) -> Column:
            text, text_tokens = self.visit_text(part)
            kind = F.coalesce(part["kind"], F.lit("text"))
            tokens = F.when(kind == "text", text_tokens).when(kind == "image", self.visit_image(part)).when(kind == "audio", self.visit_audio(part)).when(kind == "document", self.visit_document(part)).otherwise(0)
            place = F.concat(F.lit("<"), escape(kind), F.lit(":"), i.cast("string"), F.lit(":"), tokens.cast("string"), F.lit("/>"))
            return F.struct(kind.alias("kind"), F.when(kind == "text", text).otherwise(place).alias("rendered"), part["uri"].alias("uri"), tokens.cast("bigint").alias("tokens"))

        return F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), one)


def text_part(text: Column) -> Column:
    """The parts of a message that is one text."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("double").alias("amount")))


def format_conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", visitor: PartVisitor | None = None, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: formatted, loss_spans (code points, of the trained role's texts), attachments.

    One shuffle, by conversation, serves the running offsets and the grouping.
    """
    visitor = visitor or PartVisitor()
    role = F.coalesce(F.col(role_col), F.lit(""))
    m = messages.select(F.col(conv_col), F.col(turn_col).alias("_turn"), role.alias("_role"), visitor.flatten(F.col(parts_col)).alias("_flat"))
    head = F.concat(F.lit("<turn "), escape(F.col("_role")), F.lit(">\n"))
    m = m.select(conv_col, "_turn", "_role", "_flat", head.alias("_head"), F.array_join(F.transform("_flat", lambda p: p["rendered"]), "").alias("_body"))
    m = m.withColumn("_segment", F.concat("_head", "_body", F.lit("</turn>\n")))
    order = Window.partitionBy(conv_col).orderBy("_turn", "_role", "_body")
    before = F.coalesce(F.sum(F.length("_segment")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    m = m.withColumn("_n", F.row_number().over(order)).withColumn("_at", before + F.length("_head"))

    def spans(flat: Column, at: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            first = at + F.aggregate(F.slice(flat, F.lit(1), i), F.lit(0).cast("bigint"), lambda a, q: a + F.length(q["rendered"]))
            return F.struct(p["kind"].alias("kind"), first.alias("start"), (first + F.length(p["rendered"])).alias("end"), p["uri"].alias("uri"), p["tokens"].alias("tokens"))

        return F.transform(flat, one)

    m = m.withColumn("_spans", spans(F.col("_flat"), F.col("_at")))
    turns = F.sort_array(F.collect_list(F.struct("_n", "_segment", "_role", "_spans")))
    g = m.groupBy(conv_col).agg(turns.alias("_t"))
    loss = F.flatten(F.transform(F.filter("_t", lambda t: t["_role"] == trained_role), lambda t: F.transform(F.filter(t["_spans"], lambda s: s["kind"] == "text"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))))
    files = F.flatten(F.transform("_t", lambda t: F.filter(t["_spans"], lambda s: s["kind"] != "text")))
    tokens = F.aggregate(F.flatten(F.transform("_t", lambda t: t["_spans"])), F.lit(0).cast("bigint"), lambda a, s: a + s["tokens"])
    return g.select(conv_col, F.array_join(F.transform("_t", lambda t: t["_segment"]), "").alias("formatted"), loss.alias("loss_spans"), files.alias("attachments"), tokens.alias("n_tokens"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; what format_conversations wrote, read back."""
    out = []
    for segment in formatted.split("</turn>\n")[:-1]:
        head, _, body = segment.partition(">\n")
        out.append((unescape(head[len("<turn ") :]), unescape(body)))
    return out


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Turn and loss digests, taken from the formatted text and its mask alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                rows.append((len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[conv_col, *names])

    slim = formatted.select(conv_col, "formatted", "loss_spans")
    return slim.mapInArrow(run, f"`{conv_col}` {slim.dtypes[0][1]}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
