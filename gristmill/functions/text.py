"""Column builders for text: stripping, chat and question formats, prompts, truncation. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that Python's str.strip() and str.splitlines() know.
SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"

# Role labels, stop sequences and the system prompt of the chat format.
ROLES = {"user": "User", "assistant": "Assistant", "system": "System"}
STOP_SEQUENCES = ("\nUser:", "\nAssistant:", "\nSystem:")
SYSTEM_PROMPT = "You are a helpful assistant."


#: The same characters as SPACE, one by one.
SPACES = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
#: One of them, as a pattern that passes most others over after two comparisons: a table for Latin ones, a range for the rest.
GAP = f"[{''.join(f'\\x{ord(c):02x}' for c in SPACES if c < chr(256))}[\\x{{1680}}-\\x{{3000}}&&[{''.join(f'\\x{{{ord(c):x}}}' for c in SPACES if c > chr(255))}]]]"


def strip(c: Column | str) -> Column:
    """Looks at the ends alone; a pattern would look at every character."""
    return F.btrim(c, F.lit(SPACES))


def one_line(c: Column | str) -> Column:
    """Stripped, with every line end replaced by a space."""
    return F.regexp_replace(strip(c), LINE_ENDS, " ")


def words(c: Column | str) -> Column:
    """Runs of characters other than white space; cutting at the spaces takes a tenth of the time that extracting matches does."""
    return F.array_remove(F.split(c, f"{GAP}+"), "")


def text_field(columns: Sequence[tuple[str, str]], preferred: str | None = None) -> str:
    """The column that holds the text: the preferred one, else the first known name that is a string. Columns are df.dtypes."""
    kinds = dict(columns)
    if preferred:
        if kinds.get(preferred) != "string":
            raise ValueError(f"{preferred} is not a string column")
        return preferred
    for name in ("text", "content", "raw_content", "document"):
        if kinds.get(name) == "string":
            return name
    raise ValueError("no text column found")


def role_label(role: Column, empty: str = "User") -> Column:
    """User, Assistant or System; another role is capitalised, an empty one gets a default."""
    low = F.lower(role)
    label = F.when(low == "", F.lit(empty)).otherwise(F.concat(F.upper(F.substr(low, F.lit(1), F.lit(1))), F.substr(low, F.lit(2))))
    for name, shown in ROLES.items():
        label = F.when(low == name, F.lit(shown)).otherwise(label)
    return label


def conversation(messages: Column) -> Column:
    """Lines of `Role: content` from an array of (role, content); blank contents are left out, null messages give ''."""
    given = F.filter(messages, lambda m: strip(F.coalesce(m["content"], F.lit(""))) != "")
    lines = F.transform(given, lambda m: F.concat(role_label(F.coalesce(m["role"], F.lit(""))), F.lit(": "), strip(m["content"])))
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))


def question_answer(question: Column, answer: Column) -> Column:
    """`User: q` and `Assistant: a`; empty if either is blank."""
    q, a = strip(F.coalesce(question, F.lit(""))), strip(F.coalesce(answer, F.lit("")))
    return F.when((q == "") | (a == ""), F.lit("")).otherwise(F.concat(F.lit("User: "), q, F.lit("\nAssistant: "), a))


def formatted(columns: Sequence[str], kind: str) -> Column:
    """A source's rows as text, by its format and the columns that it has."""
    if kind in ("chat", "conversation") or "messages" in columns:
        return conversation(F.col("messages")) if "messages" in columns else F.lit("")
    if kind == "gsm8k" or {"question", "answer"} <= set(columns):
        return question_answer(*(F.col(c) if c in columns else F.lit("") for c in ("question", "answer")))
    return strip(F.coalesce(F.col("text"), F.lit(""))) if "text" in columns else F.lit("")


def normal_messages(messages: Column) -> Column:
    """Lower-cased roles, stripped contents, and no message that lacks either."""
    clean = F.transform(messages, lambda m: F.struct(F.lower(F.coalesce(m["role"], F.lit(""))).alias("role"), strip(F.coalesce(m["content"], F.lit(""))).alias("content")))
    return F.filter(clean, lambda m: (m["role"] != "") & (m["content"] != ""))


def turn_texts(messages: Column) -> Column:
    """`Role: content` of each normalised message, with a line feed before all but the first."""
    return F.transform(messages, lambda m, i: F.concat(F.when(i > 0, F.lit("\n")).otherwise(F.lit("")), role_label(m["role"], ""), F.lit(": "), m["content"]))


def chat_prompt(messages: Column, system: str = SYSTEM_PROMPT) -> Column:
    """The prompt that an answer follows: system line, turns, `Assistant:`. Unknown roles are users."""
    def line(m: Column) -> Column:
        role = F.lower(strip(F.coalesce(m["role"], F.lit(""))))
        label = F.when(role == "assistant", "Assistant").when(role == "system", "System").otherwise("User")
        return F.concat(label, F.lit(": "), strip(m["content"]))

    given = F.filter(messages, lambda m: strip(F.coalesce(m["content"], F.lit(""))) != "")
    first = [F.lit(f"System: {system.strip()}")] if system.strip() else []
    empty = F.array().cast("array<string>")
    parts = F.concat(F.array(*first) if first else empty, F.coalesce(F.transform(given, line), empty), F.array(F.lit("Assistant:")))
    return F.array_join(parts, "\n")


def trim_stops(text: Column, stops: Sequence[str] = STOP_SEQUENCES) -> Column:
    """The text up to the earliest stop sequence."""
    at = [F.when(F.locate(s, text) > 0, F.locate(s, text)) for s in stops if s]
    if not at:
        return text
    first = F.least(*at) if len(at) > 1 else at[0]
    return F.when(first.isNull(), text).otherwise(F.substr(text, F.lit(1), first - 1))


def left_truncated(ids: Column, context: int) -> Column:
    """The last `context` ids."""
    return F.slice(ids, F.greatest(F.lit(1), F.size(ids) - context + 1), context)


def right_truncated(ids: Column, block: int) -> Column:
    """The first block + 1 ids."""
    return F.slice(ids, 1, block + 1)


def blank_filled(sentence: Column, option: Column) -> Column:
    """(context, ending): a sentence cut at its first underscore, with the option before what follows."""
    parts = F.split(sentence, "_", 2)
    return F.struct(parts[0].alias("context"), F.concat(option, parts[1]).alias("ending"))


def after_marker(text: Column, marker: str = "####") -> Column:
    """What follows the last marker, stripped; null without one."""
    return F.when(F.contains(text, F.lit(marker)), strip(F.substring_index(text, marker, -1)))


def numeric_answer(text: Column) -> Column:
    """What follows the last ####, else the last number, else ''."""
    numbers = F.regexp_extract_all(text, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))
    return F.coalesce(after_marker(text), F.try_element_at(numbers, F.lit(-1)), F.lit(""))
