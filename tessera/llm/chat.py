"""Chat formatting with DataFrame functions alone.

The turns of a conversation are collected as structs and sorted; neighbours of one role are merged into one block; a block
is its role's opening mark, the texts with NEXT between them, and its closing mark; blocks are concatenated behind START.
Texts can't speak the template's language: in every control string that a text holds, a backslash is put behind its first
character, after those that stand there already, so escaped texts hold no control string and unescaping takes back one
backslash each. The loss mask is a list of byte spans of the formatted text (UTF-8), one for each assistant text.

    <s><<SYS>> a system text <</SYS>>[INST] a user text [/INST] an assistant text </s>
    [INST] two user[NEXT]texts in a row [/INST][ROLE]tool[SAYS] what another role says [/ROLE]

(spaces and line breaks of this sample are for the eye; a block holds its texts as they are between its marks.)

Each step goes over a conversation once: merging looks at neighbours, offsets are sums over groups of GROUP turns first, and
byte spans are cut without walking over what lies before them. A conversation is one row by its digest's nature, so its
turns meet in one task whatever the method; a row holds 2 GB at most.

Defined cases: a null text is empty; turns are sorted by turn, then role, then text, nulls first; a null role counts as an
empty name of its own; other roles than system, user and assistant carry their name in the block, escaped; repeated rows are
turns each; rows without conv_id are one conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import table

START, NEXT = "<s>", "[NEXT]"
#: Opening and closing mark of each role.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("", "</s>")}
#: Marks of any other role: the name stands between the first two.
NAMED = ("[ROLE]", "[SAYS]", "[/ROLE]")
#: Turns whose lengths are summed together before the groups' sums are.
GROUP = 256
#: A control string's first character, backslashes behind it, and its rest.
CONTROL = r"([<\[])(\\*)(/?INST\]|/?ROLE\]|SAYS\]|NEXT\]|/?s>|<SYS>>|</SYS>>)"
#: A control string as the template writes it.
WRITTEN = r"<s>|</s>|<<SYS>>|<</SYS>>|\[/?INST\]|\[/?ROLE\]|\[SAYS\]|\[NEXT\]"
ROLE_OF_END = {end: role for role, (_, end) in MARKS.items()}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL.replace(r"(\\*)", r"(\\*)\\"), "$1$2$3")


def sums_before(lengths: Column) -> Column:
    """For each number of an array the sum of those before it, by groups."""
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)

    def grouped(groups: Column) -> Column:
        def based(sums: Column) -> Column:
            return F.flatten(
                F.transform(groups, lambda g, k: let(total(F.slice(sums, F.lit(1), k)), lambda base: F.transform(g, lambda _, i: base + total(F.slice(g, F.lit(1), i)))))
            )

        return let(F.transform(groups, total), based)

    starts = F.when(F.size(lengths) > 0, F.sequence(F.lit(1), F.size(lengths), F.lit(GROUP))).otherwise(F.array().cast("array<int>"))
    return let(F.transform(starts, lambda s: F.slice(lengths, s, F.lit(GROUP))), grouped)


def merged_turns(turns: Column) -> Column:
    """Of sorted turns structs (role, head, body, tail): neighbours of one role share one opening and one closing mark."""

    def piece(t: Column, i: Column) -> Column:
        before, after = F.get(turns, i - 1), F.get(turns, i + 1)
        starts = before.isNull() | ~before.role.eqNullSafe(t.role)
        ends = after.isNull() | ~after.role.eqNullSafe(t.role)
        opening, closing = F.concat(F.lit(NAMED[0]), escaped(t.role), F.lit(NAMED[1])), F.lit(NAMED[2])
        for role, (begin, end) in MARKS.items():
            opening, closing = F.when(t.role == role, begin).otherwise(opening), F.when(t.role == role, end).otherwise(closing)
        return F.struct(t.role.alias("role"), F.when(starts, opening).otherwise(NEXT).alias("head"), escaped(t.text).alias("body"), F.when(ends, closing).otherwise("").alias("tail"))

    return F.transform(turns, piece)


def formatted(rows: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, formatted, and loss_spans: array of (start, length) in bytes of formatted."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    pieces = turns.select("conv_id", let(F.col("turns"), merged_turns).alias("pieces"))
    size = lambda p: (F.octet_length(p.head) + F.octet_length(p.body) + F.octet_length(p.tail)).cast("long")

    def spans(p: Column) -> Column:
        def cut(at: Column) -> Column:
            every = F.transform(p, lambda x, i: F.struct(x.role.alias("role"), (F.get(at, i) + len(START) + F.octet_length(x.head)).alias("start"), F.octet_length(x.body).cast("long").alias("length")))
            return F.transform(F.filter(every, lambda x: x.role == "assistant"), lambda x: F.struct(x.start, x.length))

        return let(sums_before(F.transform(p, size)), cut)

    text = F.concat(F.lit(START), F.array_join(F.transform("pieces", lambda p: F.concat(p.head, p.body, p.tail)), ""))
    return pieces.select("conv_id", text.alias("formatted"), let(F.col("pieces"), spans).alias("loss_spans"))


def under_mask(text: Column, spans: Column) -> Column:
    """Array of the texts that the spans cover, unescaped."""
    cut = lambda raw: F.transform(spans, lambda s: F.decode(F.substring(raw, s.start.cast("int") + 1, s.length.cast("int")), "UTF-8"))
    return F.transform(let(F.encode(text, "UTF-8"), cut), unescaped)


def read_back(text: Column) -> Column:
    """The turns (role, text) of a formatted conversation.

    Between two control strings lies one piece of text. A piece that ends at NEXT or a closing mark is a turn's; its role is
    that of the next closing mark, found by going backwards over the marks.
    """

    def turns(marks: Column, parts: Column) -> Column:
        # parts[k] lies before marks[k]; parts[0] is empty, marks[0] is START.
        closing = [*ROLE_OF_END, NAMED[2]]
        ends = F.filter(F.sequence(F.lit(0), F.size(marks) - 1), lambda k: F.get(marks, k).isin(closing))

        def block(end: Column, b: Column) -> Column:
            first = F.coalesce(F.get(ends, b - 1), F.lit(0)) + 1
            mark = F.get(marks, end)
            # An opening mark and a name lie before the texts, but for the assistant's.
            skipped = F.when(mark == "</s>", 0).when(mark == NAMED[2], 2).otherwise(1)
            role = unescaped(F.get(parts, first + 1))
            for close, name in ROLE_OF_END.items():
                role = F.when(mark == close, name).otherwise(role)
            return let(role, lambda r: F.transform(F.slice(parts, first + skipped + 1, end - first - skipped + 1), lambda x: F.struct(r.alias("role"), unescaped(x).alias("text"))))

        return F.flatten(F.transform(ends, block))

    return let(F.struct(F.regexp_extract_all(text, F.lit(WRITTEN), F.lit(0)).alias("marks"), F.split(text, WRITTEN, -1).alias("parts")), lambda x: turns(x.marks, x.parts))


def digests(chats: DataFrame) -> DataFrame:
    """What a formatted conversation holds, read from its text and mask."""
    read = chats.select("conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"), read_back(F.col("formatted")).alias("turns"), F.array_join(under_mask(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    sha = lambda x: F.sha2(F.encode(x, "UTF-8"), 256)
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"), "formatted_chars"
    )


def op11_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    return digests(formatted(rows.unionByName(more)))


OP11_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), near AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
    regexp_replace(text, '([<\[])(\\*)(/?INST\]|/?ROLE\]|SAYS\]|NEXT\]|/?s>|<SYS>>|</SYS>>)', '\1\2\\\3', 'g') AS body
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), sized AS (
  SELECT *, length(body)
    + CASE WHEN before IS NOT DISTINCT FROM role THEN 6 WHEN role = 'system' THEN 7 WHEN role = 'user' THEN 6 WHEN role = 'assistant' THEN 0 ELSE 12 + length(role) END
    + CASE WHEN after IS NOT DISTINCT FROM role THEN 0 WHEN role = 'system' THEN 8 WHEN role = 'user' THEN 7 WHEN role = 'assistant' THEN 4 ELSE 7 END AS chars
  FROM near
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
