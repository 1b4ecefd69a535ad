"""Captions, option letters, questions, answers, prompts and paths as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Captions of motor imagery actions.
MOTOR_CAPTIONS = {
    "right_hand": "Motor Imagery task. This person is trying to lift his right hand.",
    "left_hand": "Motor Imagery task. This person is trying to lift his left hand.",
    "feet": "Motor Imagery task. This person is trying to move his foot.",
    "foot": "Motor Imagery task. This person is trying to move his foot.",
    "tongue": "Motor Imagery task. This person is trying to move his tongue.",
    "right": "Motor Imagery task. This person is trying to lift his right hand.",
    "left": "Motor Imagery task. This person is trying to lift his left hand.",
}
# Answer pattern and its separators; words replaced in captions.
ANSWER = r"[A-Z]{1,2}(?:[、, ，]+[A-Z]{1,2})*"
ANSWER_SEPARATORS = "[、, ，]+"
PICTURE_WORDS = "image|picture|photo|img|photograph|snapshot"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def decode_and_clean(x: Column | str) -> Column:
    return F.trim(_c(x).cast("string"))


def fixed_width(x: Column | str, width: int = 192) -> Column:
    """Cut to width characters, or padded with spaces to it."""
    return F.rpad(F.coalesce(_c(x), F.lit("")), width, " ")


def capitalise(x: Column | str) -> Column:
    """First letter upper, the rest lower, for names of two characters or more."""
    c = _c(x)
    return F.when(F.length(c) >= 2, F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))).otherwise(c)


def guard(ok: Column, value: Column, message: Column) -> Column:
    """value where ok, else an error with message."""
    return F.when(ok, value).otherwise(F.raise_error(message))


def motor_caption(action: Column | str, strict: bool = True) -> Column:
    c = _c(action)
    found = F.create_map(*(F.lit(x) for kv in MOTOR_CAPTIONS.items() for x in kv))[c]
    return guard(found.isNotNull(), found, F.concat(F.lit("unknown action: "), c)) if strict else found


def _named(prefix: str, name: Column, suffix: str, strict: bool) -> Column:
    out = F.concat(F.lit(prefix), name, F.lit(suffix))
    return guard(~name.rlike(r"^[0-9]+$"), out, F.concat(F.lit("a number is no label name: "), name)) if strict else out


def emotion_caption(label: Column | str, strict: bool = True) -> Column:
    return _named("Emotion Recognition Task. This person is watching ", _c(label), " video.", strict)


def valence_arousal_caption(valence: Column | str, arousal: Column | str) -> Column:
    return F.concat(F.lit("Emotion Recognition Task. This person is watching video with "), _c(valence), F.lit(" valence and "), _c(arousal), F.lit(" arousal emotion."))


def sleep_caption(stage: Column | str, strict: bool = True) -> Column:
    return _named("Sleep Stage Recognition Task. This person is in ", _c(stage), ".", strict)


def label_by_words(caption: Column | str, rules: list[tuple[str, int]], strict: bool = False) -> Column:
    """The number of the first word the caption contains; null for none, or with strict an error that names the caption."""
    c = _c(caption)
    none = F.raise_error(F.concat(F.lit("no label for caption: "), F.coalesce(c, F.lit("null")))) if strict else F.lit(None)
    return reduce(lambda rest, rule: F.when(c.contains(rule[0]), F.lit(rule[1])).otherwise(rest), reversed(rules), none.cast("int"))


def option_letter(i: Column | str) -> Column:
    """A ... Z, then AA, AB, ... for numbers from 0."""
    c = _c(i).cast("int")
    letter = lambda k: F.char(F.lit(65) + k)
    return F.when(c < 26, letter(c)).otherwise(F.concat(letter(F.floor(c / 26).cast("int") - 1), letter(F.pmod(c, F.lit(26)))))


def render_question(template: Column | str, options: Column | str) -> Column:
    """template with " (A)x (B)y ..." after it."""
    told = F.transform(_c(options), lambda o, i: F.concat(F.lit(" ("), option_letter(i), F.lit(")"), o))
    return F.concat(_c(template), F.array_join(told, ""))


def parse_answer(x: Column | str) -> Column:
    """The last group of option letters, without separators; empty for none."""
    last = F.try_element_at(F.regexp_extract_all(_c(x), F.lit(f"({ANSWER})"), F.lit(1)), F.lit(-1))
    return F.regexp_replace(F.coalesce(last, F.lit("")), ANSWER_SEPARATORS, "")


def parse_options(question: Column | str) -> Column:
    """Map of upper-cased letter to name of "(L) name" parts; a letter that occurs again takes its last name."""
    pattern = r"\(([^)]*)\)([^(]*)"
    q = _c(question)
    letters = F.transform(F.regexp_extract_all(q, F.lit(pattern), F.lit(1)), lambda x: F.upper(F.trim(x)))
    names = F.transform(F.regexp_extract_all(q, F.lit(pattern), F.lit(2)), lambda x: F.trim(x))
    pairs = F.arrays_zip(letters.alias("l"), names.alias("n"))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(letters, i + 2, F.size(letters)), p["l"]))
    return F.map_from_entries(last)


def valid_answer(answer: Column | str, correct: Column | str, options: Column | str) -> Column:
    """True where the upper-cased answer is a letter of the options and the correct one."""
    a = F.upper(F.trim(_c(answer)))
    return F.map_contains_key(_c(options), a) & (a == F.upper(F.trim(_c(correct))))


def prediction_code(x: Column | str, index: int, codes: dict[str, int]) -> Column:
    """The number of the token at index (from 0) among white-space tokens, of its first three characters where it opens
    with a bracket; -1 if there is none or it is unknown."""
    token = F.try_element_at(F.split(_c(x), " "), F.lit(index + 1))
    key = F.when(token.startswith("("), F.left(token, F.lit(3))).otherwise(token)
    known = F.create_map(*(F.lit(v) for kv in codes.items() for v in kv))
    return F.coalesce(F.try_element_at(known, key), F.lit(-1))


def replace_words(x: Column | str, by: str = "EEG") -> Column:
    return F.regexp_replace(_c(x), rf"(?i)\b(?:{PICTURE_WORDS})s?\b", by)


def class_from_caption(x: Column | str) -> Column:
    """The last two words without a final full stop and a leading "a "."""
    words = F.filter(F.split(F.trim(_c(x)), r"\s+"), lambda w: w != "")
    two = F.array_join(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), 2), " ")
    return F.regexp_replace(F.regexp_replace(two, r"\.$", ""), "^a ", "")


def word_at(x: Column | str, i: int) -> Column:
    """Word i, from 0, of a text split at single spaces; null if there is none."""
    return F.try_element_at(F.split(_c(x), " "), F.lit(i + 1))


def basename(x: Column | str) -> Column:
    return F.substring_index(_c(x), "/", -1)


def stem(x: Column | str) -> Column:
    return F.regexp_replace(basename(x), r"\.[^.]*$", "")


def before_underscore(x: Column | str) -> Column:
    return F.substring_index(_c(x), "_", 1)


def after_underscore(x: Column | str) -> Column:
    c = _c(x)
    return F.when(F.instr(c, "_") > 0, F.substr(c, F.instr(c, "_") + 1)).otherwise(c)


def daily_log_name(ts: Column | str) -> Column:
    return F.concat(F.date_format(_c(ts), "yyyy-MM-dd"), F.lit("-conv.json"))


def word_count(x: Column | str) -> Column:
    return F.size(F.filter(F.split(_c(x), r"\s+"), lambda w: w != ""))


def turns_state(turns: Column | str, system: Column | str, roles: list[str]) -> Column:
    """A conversation's state as JSON: system, roles and messages (pairs of role and text; a null text stays null)."""
    pairs = F.transform(_c(turns), lambda x: F.array(x["role"], x["text"]))
    return F.to_json(F.struct(_c(system).alias("system"), F.array(*(F.lit(r) for r in roles)).alias("roles"), pairs.alias("messages")))


WHITE = " \t\n\x0b\x0c\r"


def strip_placeholder(x: Column | str, front: Column, mark: str = "<image>", wrap: tuple[str, str] | None = None) -> Column:
    """The text without placeholders, trimmed, with one put back in front or behind; double line breaks become one. wrap: strings put
    before and after the placeholder."""
    bare = F.btrim(F.replace(_c(x), F.lit(mark), F.lit("")), F.lit(WHITE))
    put = F.when(front, F.concat(F.lit(mark + "\n"), bare)).otherwise(F.concat(bare, F.lit("\n" + mark)))
    put = F.replace(put, F.lit("\n\n"), F.lit("\n"))
    return F.replace(put, F.lit(mark), F.lit(wrap[0] + mark + wrap[1])) if wrap else put


def ask_with(x: Column | str, context: Column, front: Column, mark: str = "<image>") -> Column:
    """A question with context as its next sentence, the placeholder (if it has one) moved in front or behind; unchanged for null context."""
    bare = F.btrim(F.replace(_c(x), F.lit(mark), F.lit("")), F.lit(WHITE))
    told = F.concat(bare, F.lit(". "), context)
    moved = F.when(front, F.concat(F.lit(mark + "\n"), told)).otherwise(F.concat(told, F.lit(f" {mark}\n")))
    return F.when(context.isNull(), _c(x)).when(F.contains(_c(x), F.lit(mark)), moved).otherwise(F.concat(_c(x), F.lit(". "), context))


def render_prompt(turns: Column | str, style: str, system: Column | str, sep: str, sep2: str = "") -> Column:
    """Prompt of turns (array of struct role, text; an empty or null text opens that turn) in one of the styles single, two,
    chatml, mpt, gemma, llama_2 and plain."""
    t, s = _c(turns), _c(system)
    empty = lambda x: x["text"].isNull() | (x["text"] == "")
    alt = lambda i: F.when(i % 2 == 0, sep).otherwise(sep2)
    join = lambda f: F.array_join(F.transform(t, f), "")
    if style == "single":
        return F.concat(s, F.lit(sep), join(lambda x, i: F.when(empty(x), F.concat(x["role"], F.lit(":"))).otherwise(F.concat(x["role"], F.lit(": "), x["text"], F.lit(sep)))))
    if style == "two":
        return F.concat(s, F.lit(sep), join(lambda x, i: F.when(empty(x), F.concat(x["role"], F.lit(":"))).otherwise(F.concat(x["role"], F.lit(": "), x["text"], alt(i)))))
    if style == "chatml":
        head = F.when(s == "", "").otherwise(F.concat(s, F.lit(sep + "\n")))
        return F.concat(head, join(lambda x, i: F.when(empty(x), F.concat(x["role"], F.lit("\n"))).otherwise(F.concat(x["role"], F.lit("\n"), x["text"], F.lit(sep + "\n")))))
    if style in ("mpt", "gemma"):
        body = join(lambda x, i: F.when(empty(x), x["role"]).otherwise(F.concat(x["role"], x["text"], F.lit(sep))))
        return F.concat(s, F.lit(sep), body) if style == "mpt" else body
    if style == "llama_2":
        wrapped = F.when(F.length(s) > 0, F.concat(F.lit("<<SYS>>\n"), s, F.lit("\n<</SYS>>\n\n"))).otherwise(s)
        return join(lambda x, i: F.when(empty(x), "").when(i % 2 == 0, F.concat(F.lit(sep + "[INST] "), F.when(i == 0, wrapped).otherwise(""), x["text"], F.lit(" [/INST]"))).otherwise(F.concat(F.lit(" "), x["text"], F.lit(sep2))))
    if style == "plain":
        return F.concat(s, join(lambda x, i: F.when(empty(x), "").otherwise(F.concat(x["text"], alt(i)))))
    raise ValueError(f"no such style: {style}")
