"""Conversations from files and task tables, and the generated spelling and prompt tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palinode.functions.seeded import seed_key, seed_pick, seed_uniform
from palinode.functions.text import (
    count_letter, counting_lines, fill_template, letter_of, letters_of, render_mc, spell, split_tool_calls)
from palinode.operators.conversations import assemble_conversations, keep_valid
from palinode.operators.ordered import dense_index
from palinode.session import cut_lineage

PART = "struct<type:string,text:string>"
_MESSAGES = "array<struct<role:string,content:string>>"

# Alphabet, draws of the test split, task letters.
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
TEST_SEED_OFFSET = 10_000_000
LETTERS = ("A", "B", "C", "D")

# The user message variants of the letter-counting task.
SPELLING_TEMPLATES = (
    "How many {letter} are in the word {word}", "How many {letter} are in {word}",
    "Count the number of {letter} in {word}", "How many times does {letter} appear in {word}",
    "What's the count of {letter} in {word}", "In the word {word}, how many {letter} are there",
    "How many letter {letter} are in the word {word}", "Count how many {letter} appear in {word}",
    "Tell me the number of {letter} in {word}", "How many occurrences of {letter} are in {word}",
    "Find the count of {letter} in {word}", "Can you count the {letter} letters in {word}",
    "What is the frequency of {letter} in {word}", "How many {letter}s are in {word}",
    "How many {letter}'s are in {word}", "Count all the {letter} in {word}",
    "How many times is {letter} in {word}", "Number of {letter} in {word}",
    "Total count of {letter} in {word}", "How many {letter} does {word} have",
    "How many {letter} does {word} contain", "What's the number of {letter} in {word}",
    "{word} has how many {letter}", "In {word}, count the {letter}",
    "How many {letter} appear in {word}", "Count the {letter} in {word}",
    "Give me the count of {letter} in {word}", "How many instances of {letter} in {word}",
    "Show me how many {letter} are in {word}", "Calculate the number of {letter} in {word}",
    "¿Cuántas {letter} hay en {word}?", "¿Cuántas veces aparece {letter} en {word}?",
    "Cuenta las {letter} en {word}", "¿Cuántas letras {letter} tiene {word}?",
    "{word}中有多少个{letter}", "{word}里有几个{letter}", "数一下{word}中的{letter}",
    "{word}这个词里有多少{letter}", "{word}에 {letter}가 몇 개 있나요", "{word}에서 {letter}의 개수는",
    "{word}에 {letter}가 몇 번 나오나요", "{word}라는 단어에 {letter}가 몇 개",
    "Combien de {letter} dans {word}", "Combien de fois {letter} apparaît dans {word}",
    "Compte les {letter} dans {word}", "Wie viele {letter} sind in {word}",
    "Wie oft kommt {letter} in {word} vor", "Zähle die {letter} in {word}",
    "{word}に{letter}は何個ありますか", "{word}の中に{letter}がいくつ", "{word}に{letter}が何回出てくる",
)


def text_part(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))


def message(role: str, parts: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), parts.alias("parts"))


def _conversation(df: DataFrame, idx: str, user: Column, assistant_parts: Column, letters: Column | None = None,
                  subject: Column | None = None, extra: Column | None = None) -> DataFrame:
    return df.select(
        F.col(idx).alias("conv_id"),
        F.array(message("user", text_part(user)), message("assistant", assistant_parts)).alias("messages"),
        (letters if letters is not None else F.lit(None)).cast("array<string>").alias("letters"),
        (subject if subject is not None else F.lit(None)).cast("string").alias("subject"),
        (extra if extra is not None else F.lit(None)).cast("map<string,string>").alias("extra"))


# ---- files -----------------------------------------------------------------------------------------

def read_conversations_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, messages): one JSON array of messages per line, blank lines skipped. A line that is
    not such an array has null messages."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("line"))
    return lines.where("line <> ''").withColumn("messages", F.from_json("line", _MESSAGES))


def turns_of(convs: DataFrame, keys: Sequence[str], messages: str = "messages") -> DataFrame:
    """(keys, turn, role, text), the shape the conversation checks take."""
    return convs.select(*keys, F.posexplode(messages).alias("turn", "m")).select(
        *keys, F.col("turn").cast("long").alias("turn"), F.col("m.role").alias("role"), F.col("m.content").alias("text"))


def write_conversations(turns: DataFrame, path: str, mode: str = "overwrite", metadata: Column | None = None) -> None:
    """JSONL sink: one line per conversation, or an object with messages and metadata."""
    msgs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "turn", "role", F.col("text").alias("content")))).alias("m"))
    plain = F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    line = plain if metadata is None else F.struct(plain.alias("messages"), metadata.alias("metadata"))
    msgs.select(F.to_json(line).alias("value")).write.mode(mode).text(path)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''")


def smoltalk_conversations(turns: DataFrame) -> DataFrame:
    """General chat: the valid conversations of a turn table, in the shared shape."""
    none = {"letters": "array<string>", "subject": "string", "extra": "map<string,string>"}
    return assemble_conversations(keep_valid(turns)).withColumns({k: F.lit(None).cast(t) for k, t in none.items()})


# ---- task tables -----------------------------------------------------------------------------------

def mmlu_conversations(df: DataFrame, idx: str = "idx") -> DataFrame:
    """(question, choices[4], answer index, subject)."""
    letters = F.array(*[F.lit(c) for c in LETTERS])
    return _conversation(df, idx, render_mc(F.col("question"), letters, F.col("choices")),
                         text_part(letter_of(F.col("answer"), letters)), letters, F.col("subject"))


def arc_conversations(df: DataFrame, idx: str = "idx") -> DataFrame:
    """(question, choices STRUCT<text, label>, answerKey)."""
    return _conversation(df, idx, render_mc(F.col("question"), F.col("choices.label"), F.col("choices.text")),
                         text_part(F.col("answerKey")), F.col("choices.label"))


def gsm8k_conversations(df: DataFrame, idx: str = "idx") -> DataFrame:
    """(question, answer with tool-call markers)."""
    return _conversation(df, idx, F.col("question"), split_tool_calls(F.col("answer")))


def humaneval_conversations(df: DataFrame, idx: str = "idx") -> DataFrame:
    """(prompt, canonical_solution, entry_point, test)."""
    extra = F.create_map(F.lit("entry_point"), F.col("entry_point"), F.lit("test"), F.col("test"))
    return _conversation(df, idx, F.col("prompt"),
                         text_part(F.concat("prompt", F.lit("\n"), "canonical_solution")), extra=extra)


# ---- generators ------------------------------------------------------------------------------------

def indexed_words(words: DataFrame, seed: int = 42, word: str = "word") -> DataFrame:
    """(word_idx, word) in a seeded order."""
    keyed = words.select(word).distinct().withColumn("__key", seed_key(seed, word))
    return dense_index(keyed, ["__key", word], "word_idx", uniform_hex=True).select("word_idx", F.col(word).alias("word"))


def draw_words(ids: DataFrame, indexed: DataFrame, seed_col: Column, salt: str) -> DataFrame:
    """Give every id a word: a seeded index joined to the word list, which is derived once. Its size is one
    number on the driver."""
    indexed = cut_lineage(indexed)
    n = indexed.count()
    if not n:
        raise ValueError("empty word list")
    return ids.withColumn("word_idx", seed_pick(n, salt, seed_col)).join(indexed, "word_idx").drop("word_idx")


def spelling_bee(ids: DataFrame, words: DataFrame, idx: str = "idx", split: str = "train") -> DataFrame:
    """(idx, word, letter, count, user_text, parts): a letter-counting problem with its worked answer."""
    seed_col = F.col(idx) + (0 if split == "train" else TEST_SEED_OFFSET)
    drawn = draw_words(ids.select(idx), indexed_words(words), seed_col, "bee-word")
    own = F.get(letters_of(F.col("word")), seed_pick(F.length("word"), "bee-letter", seed_col).cast("int"))
    other = F.substring(F.lit(ALPHABET), (seed_pick(26, "bee-any", seed_col) + 1).cast("int"), F.lit(1))
    lettered = drawn.withColumn("letter", F.when(seed_uniform("bee-own", seed_col) < 0.9, own).otherwise(other))
    templates = F.array(*[F.lit(t) for t in SPELLING_TEMPLATES])
    template = F.get(templates, seed_pick(len(SPELLING_TEMPLATES), "bee-template", seed_col).cast("int"))
    template = F.when(seed_uniform("bee-lower", seed_col) < 0.3, F.lower(template)).otherwise(template)
    quotes = F.array(F.lit(""), F.lit("'"), F.lit('"'))

    def quoted(c: str, salt: str) -> Column:
        q = F.get(quotes, seed_pick(3, salt, seed_col).cast("int"))
        return F.concat(q, F.col(c), q)

    asked = fill_template(template, quoted("word", "bee-wq"), quoted("letter", "bee-lq"))
    mark = F.when(seed_uniform("bee-mark", seed_col) < 0.5, "?").otherwise("")
    w, l = F.col("word"), F.col("letter")
    n = count_letter(w, l).cast("string")

    def part(kind: str, *text) -> Column:
        return F.struct(F.lit(kind).alias("type"),
                        F.concat(*[t if isinstance(t, Column) else F.lit(t) for t in text]).alias("text"))

    manual = part(
        "text", "We are asked to find the number '", l, "' in the word '", w,
        "'. Let me try a manual approach first.\n\nFirst spell the word out:\n", w, ":", spell(w),
        "\n\nThen count the occurrences of '", l, "':\n", counting_lines(w, l), "\nThis gives us ", n, ".")
    parts = F.array(
        manual, part("text", "\n\nLet me double check this using Python:\n\n"),
        part("python", "'", w, "'.count('", l, "')"), part("python_output", n),
        part("text", "\n\nPython gives us ", n, ".\n\nMy final answer is:\n\n#### ", n))
    return lettered.select(idx, "word", "letter", count_letter(w, l).alias("count"),
                           F.concat(asked, mark).alias("user_text"), parts.alias("parts"))


def simple_spelling(ids: DataFrame, words: DataFrame, idx: str = "idx", split: str = "train") -> DataFrame:
    """(idx, word, user_text, answer)."""
    seed_col = F.col(idx) + (0 if split == "train" else TEST_SEED_OFFSET)
    drawn = draw_words(ids.select(idx), indexed_words(words, seed=43), seed_col, "spell-word")
    return drawn.select(idx, "word", F.concat(F.lit("Spell the word: "), "word").alias("user_text"),
                        F.concat("word", F.lit(":"), spell(F.col("word"))).alias("answer"))


def generated_conversations(df: DataFrame, idx: str = "idx") -> DataFrame:
    """Spelling rows in the shared conversation shape."""
    parts = F.col("parts") if "parts" in df.columns else text_part(F.col("answer"))
    return _conversation(df, idx, F.col("user_text"), parts)


def prompt_grid(ids: DataFrame, topics: dict[str, Sequence[str]], personas: Sequence[str], dynamics: Sequence[str],
                openings: dict[str, Sequence[str]], template: str, idx: str = "idx", k: int = 3) -> DataFrame:
    """(idx, topic, persona, dynamic, first_messages, prompt): one seeded element per dimension and
    openings from k distinct categories. The dimension lists are parameters."""

    def strings(items: Sequence[str]) -> Column:
        return F.array(*[F.lit(i) for i in items])

    def draw(items: Column, salt: str, *more: Column) -> Column:
        return F.get(items, seed_pick(F.size(items), salt, F.col(idx), *more).cast("int"))

    topic = draw(draw(F.array(*[strings(v) for v in topics.values()]), "grid-category"), "grid-topic")
    cats = [(name, strings(v)) for name, v in openings.items()]
    keyed = F.array(*[F.struct(seed_key("grid-open", F.col(idx), F.lit(name)).alias("key"),
                               draw(items, "grid-msg", F.lit(name)).alias("msg")) for name, items in cats])
    firsts = F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: F.concat(F.lit("- "), s["msg"]))
    drawn = ids.select(idx, topic.alias("topic"), draw(strings(personas), "grid-persona").alias("persona"),
                       draw(strings(dynamics), "grid-dynamic").alias("dynamic"),
                       F.array_join(firsts, "\n").alias("first_messages"))
    prompt = F.lit(template)
    for name in ("topic", "persona", "dynamic", "first_messages"):
        prompt = F.replace(prompt, F.lit("{" + name + "}"), F.col(name))
    return drawn.withColumn("prompt", prompt)
