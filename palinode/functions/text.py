"""Task-text expressions: prompts, answers, tool calls, spelling, programs, report lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palinode.functions.sequences import bind

# Answer marker, tool-call marker, fenced program, report time format.
ANSWER_PATTERN = r"#### (\-?[0-9\.\,]+)"
TOOL_CALL_PATTERN = r"(?s)<<[^>]+>>"
PROGRAM_PATTERN = "(?s)```(?:python)?\\s*\\n(.*?)\\n```"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def strip(text: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def render_mc(question: Column, letters: Column, choices: Column) -> Column:
    """Multiple-choice question text; the letter follows the choice with no space before it."""
    lines = F.zip_with(choices, letters, lambda c, l: F.concat(F.lit("- "), c, F.lit("="), l, F.lit("\n")))
    return F.concat(F.lit("Multiple Choice question: "), question, F.lit("\n"), F.array_join(lines, ""),
                    F.lit("\nRespond only with the letter of the correct answer."))


def _shots(shots: Column | None, render) -> Column:
    if shots is None:
        return F.lit("")
    return F.array_join(F.transform(shots, lambda s: F.concat(render(s), F.lit("\n\n"))), "")


def mc_prompts(query: Column, choices: Column, shots: Column | None, delim: str) -> Column:
    """One prompt per choice. `shots` is ARRAY<STRUCT<query, choices, gold>>."""
    d = F.lit(delim)
    head = F.concat(_shots(shots, lambda s: F.concat(s["query"], d, F.get(s["choices"], s["gold"]))), query, d)
    return F.transform(choices, lambda c: F.concat(head, c))


def schema_prompts(options: Column, continuation: Column, shots: Column | None, delim: str) -> Column:
    """One prompt per context. `shots` is ARRAY<STRUCT<context_options, continuation, gold>>."""
    d = F.lit(delim)
    head = _shots(shots, lambda s: F.concat(F.get(s["context_options"], s["gold"]), d, s["continuation"]))
    return F.transform(options, lambda o: F.concat(head, o, d, continuation))


def lm_prompts(context: Column, continuation: Column, shots: Column | None, delim: str) -> Column:
    """[without, with] the continuation. `shots` is ARRAY<STRUCT<context, continuation>>."""
    d = F.lit(delim)
    head = F.concat(_shots(shots, lambda s: F.concat(strip(s["context"]), d, s["continuation"])),
                    strip(context), d)
    return F.array(strip(head), F.concat(head, continuation))


def extract_answer(text: Column) -> Column:
    """Number behind the answer marker without commas, or null."""
    found = F.regexp_extract(text, ANSWER_PATTERN, 1)
    return F.when(found != "", F.replace(found, F.lit(","), F.lit("")))


def answer_correct(pred: Column, ref: Column) -> Column:
    """Equal answers; two missing answers count as equal."""
    return pred.eqNullSafe(ref)


def letter_correct(response: Column, gold: Column, letters: Column) -> Column:
    """The response must be one of the letters on offer, and the right one."""
    return F.array_contains(letters, response) & (response == gold)


def letter_of(index: Column, letters: Column) -> Column:
    return F.get(letters, index)


def split_tool_calls(answer: Column) -> Column:
    """Text with `<<expr=result>>` markers to ARRAY<STRUCT<type, text>>: text, python and python_output
    parts in order. The expression ends at the last `=`; empty text parts stay."""
    calls = F.regexp_extract_all(answer, F.lit(TOOL_CALL_PATTERN), F.lit(0))
    texts = F.split(answer, TOOL_CALL_PATTERN, -1)

    def part(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), text.alias("text"))

    def call_parts(call: Column) -> Column:
        inner = F.substring(call, F.lit(3), F.length(call) - 4)
        has_result = F.contains(inner, F.lit("="))
        expr = F.when(has_result, F.regexp_extract(inner, r"(?s)^(.*)=", 1)).otherwise(inner)
        result = F.when(has_result, F.substring_index(inner, "=", -1)).otherwise(F.lit(""))
        return F.array(part("python", expr), part("python_output", result))

    steps = F.transform(texts, lambda t, i: F.concat(
        F.array(part("text", t)),
        F.when(i < F.size(calls), call_parts(F.get(calls, i))).otherwise(
            F.array().cast("array<struct<type:string,text:string>>"))))
    return F.flatten(steps)


def extract_imports(prompt: Column) -> Column:
    """Import lines at the top, up to the first line that is neither import, comment nor blank."""
    lines = F.transform(F.split(prompt, "\n", -1), strip)

    def is_import(line: Column) -> Column:
        return line.startswith("import ") | line.startswith("from ")

    stops = F.transform(lines, lambda l: ~is_import(l) & (l != "") & ~l.startswith("#"))
    first = F.array_position(stops, True)
    head = F.when(first > 0, F.slice(lines, F.lit(1), (first - 1).cast("int"))).otherwise(lines)
    return F.array_join(F.filter(head, is_import), "\n")


def extract_program(completion: Column) -> Column:
    """First fenced block (python or bare), else everything; stripped."""
    fenced = F.regexp_like(completion, F.lit(PROGRAM_PATTERN))
    return strip(F.when(fenced, F.regexp_extract(completion, PROGRAM_PATTERN, 1)).otherwise(completion))


def assemble_program(prompt: Column, completion: Column, test: Column, entry_point: Column) -> Column:
    return F.concat(extract_imports(prompt), F.lit("\n\n"), extract_program(completion), F.lit("\n\n"), test,
                    F.lit("\ncheck("), entry_point, F.lit(")"))


def letters_of(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda c: c != "")


def spell(word: Column) -> Column:
    return F.array_join(letters_of(word), ",")


def count_letter(word: Column, letter: Column) -> Column:
    return (F.length(word) - F.length(F.replace(word, letter, F.lit("")))).cast("int")


def counting_lines(word: Column, letter: Column) -> Column:
    """One line per letter, hits carrying the running count."""
    def lines(chars: Column) -> Column:
        return F.transform(chars, lambda c, i: F.concat(
            (i + 1).cast("string"), F.lit(":"), c,
            F.when(c == letter, F.concat(
                F.lit(" hit! count="),
                F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == letter)).cast("string")))
            .otherwise(F.lit("")), F.lit("\n")))

    return F.array_join(bind(letters_of(word), lines), "")


def fill_template(template: Column, word: Column, letter: Column) -> Column:
    """Single-pass fill: a filled-in word is never searched for the other placeholder."""
    marked = F.replace(F.replace(template, F.lit("{letter}"), F.lit("\u0001")), F.lit("{word}"), F.lit("\u0002"))
    return F.replace(F.replace(marked, F.lit("\u0001"), letter), F.lit("\u0002"), word)


def section_value(section: Column, key: str) -> Column:
    """Text after the first colon (up to the next) of the last line that contains `key`."""
    hits = F.filter(F.split(section, "\n", -1), lambda l: F.contains(l, F.lit(key)))
    return strip(F.get(F.split(F.get(hits, F.size(hits) - 1), ":", -1), F.lit(1)))


def ts_after(content: Column, prefix: str) -> Column:
    """Timestamp on the first line that starts with `prefix` and parses; null otherwise."""
    lines = F.filter(F.split(content, "\n", -1), lambda l: l.startswith(prefix))
    times = F.transform(lines, lambda l: F.try_to_timestamp(
        strip(F.regexp_replace(l, r"(?s)^[^:]*:", "")), F.lit(TIME_FORMAT)))
    return F.get(F.filter(times, lambda t: t.isNotNull()), F.lit(0))


def wall_clock(start: Column, end: Column) -> Column:
    """Elapsed time as XhYm, or `unknown`."""
    seconds = (F.unix_micros(end) - F.unix_micros(start)) / 1_000_000
    whole = F.floor(seconds).cast("long")
    text = F.concat(F.floor(whole / 3600).cast("string"), F.lit("h"),
                    F.floor(F.pmod(whole, F.lit(3600)) / 60).cast("string"), F.lit("m"))
    return F.coalesce(text, F.lit("unknown"))


# The log layouts of the training runs. Group 1 is the value.
LOG_FIELDS = {
    "params_wte": r"^wte [^0-9,]*([\d,]+)",
    "params_value_embeds": r"^value_embeds [^0-9,]*([\d,]+)",
    "params_lm_head": r"^lm_head [^0-9,]*([\d,]+)",
    "params_transformer": r"^transformer_matrices [^0-9,]*([\d,]+)",
    "params_scalars": r"^scalars [^0-9,]*([\d,]+)",
    "params_total": r"^total [^0-9,]*([\d,]+)",
    "num_params": r"Number of parameters:[^0-9,]*([\d,]+)",
    "num_scaling_params": r"Number of parameters:.*scaling: ([\d,]+)",
    "num_iterations": r"Calculated number of iterations.*: ([\d,]+)\s*$",
    "batch_size": r"Total batch size ([\d,]+)",
    "val_bpb": r"Validation bpb:.*?([\d.]+)$",
    "core_score": r"CORE metric:.*?(\S+)\s*$",
    "step": r"^step (\d+)/\d+",
    "loss": r"\| loss: ([\d.]+)",
    "lrm": r"\| lrm: ([\d.]+)",
    "dt_ms": r"\| dt: ([\d.]+)ms",
    "tok_sec": r"\| tok/sec: ([\d,]+)",
    "mfu": r"\| bf16_mfu: ([\d.]+)",
    "epoch": r"\| epoch: (\d+)",
    "pq": r" pq: (\d+)",
    "rg": r" rg: (\d+)",
}
# The lines a run follower keeps.
LOG_FILTER = (r"Total number of training tokens|Total batch size|Validation bpb|step [0-9]+/[0-9]+ .*loss:"
              r"|tok/sec|eta:|Flash Attention|window_pattern|Reverse training enabled")


def log_field(line: Column, name: str) -> Column:
    """Number of a named field in a log line, or null. Thousands commas are dropped."""
    found = F.regexp_extract(line, LOG_FIELDS[name], 1)
    return F.replace(found, F.lit(","), F.lit("")).try_cast("double")
