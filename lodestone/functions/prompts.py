"""Classification and templating of task texts, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that speak for a kind of task, in order of precedence.
TASK_WORDS = {
    "debug": "fix bug error crash fail broken exception traceback issue".split(),
    "coding": "implement add create build write develop feature".split(),
    "refactor": "refactor restructure clean reorganize simplify extract rename".split(),
    "review": "review audit check inspect evaluate assess critique".split(),
    "research": "explain understand how what why explore research investigate".split(),
}
# Phrases of effort.
DEEP = ["careful", "thorough", "deep dive", "production", "critical", "high stakes", "security", "performance", "migration", "architecture"]
LIGHT = "quick simple trivial minor small typo rename formatting lint style".split()
# Tools and their share of a budget.
TOOL_WEIGHTS = {
    "debug": {"search_codebase": 0.40, "get_recent_changes": 0.25, "get_file_summary": 0.20, "get_call_graph": 0.15},
    "coding": {"search_codebase": 0.55, "get_dependencies": 0.25, "search_symbols": 0.20},
    "refactor": {"get_dependencies": 0.30, "get_repo_map": 0.25, "search_codebase": 0.25, "get_call_graph": 0.20},
    "review": {"get_repo_map": 0.60, "get_file_summary": 0.40},
    "research": {"get_repo_map": 0.50, "search_codebase": 0.50},
}
# Leading phrases that carry no intent of their own, for every task and by task.
ANY_LEAD = ["analyze and improve", "analyze and fix", "help me improve", "help me fix", "analyze", "improve", "update", "migrate", "optimize"]
TASK_LEAD = {
    "debug": "fix debug resolve diagnose troubleshoot".split(),
    "coding": "implement add create build write develop".split(),
    "refactor": "refactor restructure reorganize".split(),
    "review": "review audit inspect evaluate assess critique".split(),
    "research": "explain explore research investigate describe".split(),
}


def _bounded(expr: str) -> str:
    """An expression between word ends, where letters and digits of every script make words."""
    return rf"(?<![\p{{L}}\p{{N}}_])(?:{expr})(?![\p{{L}}\p{{N}}_])"


def words_of(text: Column) -> Column:
    """The distinct words of a text in lower case."""
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"))


def task_scores(text: Column, words: Column | None = None) -> dict[str, Column]:
    """How many of each task's words stand in the text, or in its words, if they are known."""
    words = words if words is not None else words_of(text)
    return {task: F.size(F.array_intersect(words, F.array(*map(F.lit, own)))) for task, own in TASK_WORDS.items()}


def detect_task(text: Column) -> Column:
    """The task with most words in the text, the first of equals; research if there is none."""
    return best_task(task_scores(text))


def best_task(scores: dict[str, Column]) -> Column:
    best = F.greatest(*scores.values())
    out = F.when(best == 0, "research")
    for task, s in scores.items():
        out = out.when(s == best, task)
    return out


def detect_intensity(text: Column, task: Column) -> Column:
    """deep, light or standard: by phrase, deep before light; else research is light unless it is over 200 characters long."""
    any_of = lambda words: F.lower(text).rlike(_bounded("|".join(map(re.escape, words))))
    return F.when(any_of(DEEP), "deep").when(any_of(LIGHT), "light").when((task == "research") & (F.length(text) <= 200), "light").otherwise("standard")


def _lead(words: list[str]) -> str:
    longest = sorted(words, key=len, reverse=True)
    return "(?is)^(?:" + "|".join(map(re.escape, longest)) + r")\s+(\S.*)$"


def subject(text: Column, task: Column) -> Column:
    """The text without a leading phrase that its task's template replaces, or unchanged."""
    found = F.regexp_extract(text, _lead(ANY_LEAD), 1)
    out = F.when(found != "", F.trim(found))
    for t, words in TASK_LEAD.items():
        own = F.regexp_extract(text, _lead(words), 1)
        out = out.when((task == t) & (own != ""), F.trim(own))
    return out.otherwise(text)


def was_stripped(text: Column, task: Column) -> Column:
    return subject(text, task) != text


def normalize(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tags_in(text: Column) -> Column:
    """The distinct names of opening tags."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"<(\w+)>"), 1))


def missing_tags(required: Column, answer: Column) -> Column:
    return F.array_except(tags_in(required), tags_in(answer))


def answer_is_valid(required: Column, answer: Column, least: int = 100) -> Column:
    """Whether an answer has more than `least` characters and every tag that is required."""
    return (F.length(F.trim(answer)) > least) & (F.size(missing_tags(required, answer)) == 0)


def by_task(task: Column, values: dict[str, str], default: str = "research") -> Column:
    """The text that belongs to a task, else that of the default task."""
    out = F.lit(values[default])
    for k, v in values.items():
        out = F.when(task == k, F.lit(v)).otherwise(out)
    return out


def objective(text: Column, task: Column, templates: dict[str, str], suffixes: dict[str, str], note: str, bare: Column | None = None) -> Column:
    """The task's template around the subject where the leading phrase could be taken off, else the text and the task's suffix;
    below it a note and the original. Templates hold `{subject}`. bare is the subject, if it is known."""
    bare = bare if bare is not None else subject(text, task)
    framed = F.replace(by_task(task, templates), F.lit("{subject}"), bare)
    plain = F.concat(text, F.lit(". "), by_task(task, suffixes))
    return F.concat(F.when(bare != text, framed).otherwise(plain), F.lit("\n" + note + "\nOriginal request: "), text)


def numbered(task: Column, checks: dict[str, list[str]], common: list[str]) -> Column:
    """The task's checks and the common ones as a numbered list."""
    return by_task(task, {k: "\n".join(f"  {i}. {c}" for i, c in enumerate([*own, *common], 1)) for k, own in checks.items()})


#: What the parts of a composed text say, by task.
FOCUS = {
    "debug": "where the fault shows, what changed lately, and who calls the code at fault",
    "coding": "code like that to be written, what it depends on, and names to follow",
    "refactor": "everything that uses what is to change",
    "review": "the overall shape, and each file under review",
    "research": "the overall shape, and the places that answer the question",
}
STYLE = {
    "debug": "Find the cause before touching the symptom; change as little as mends it.",
    "coding": "Follow what is there; add what the task asks for and nothing besides.",
    "refactor": "Keep behaviour as it is; go in small steps that can each be checked.",
    "review": "Judge what the code does, worst findings first.",
    "research": "Answer from the code, with the places that show it.",
}
DIAGNOSIS = {
    "debug": "List what could cause this, say what would tell the candidates apart, and check the likeliest first.",
    "coding": "Say where the new code belongs, what it touches, and what could go wrong there.",
    "refactor": "List what uses the code now, and what has to stay true afterwards.",
    "review": "Say what this code is meant to do before saying how well it does it.",
    "research": "Split the question into parts that single files can answer.",
}
DONE = {
    "debug": "The cause is known, the fix is in, and every test still passes.",
    "coding": "The feature works, fits in with the rest, and treats errors.",
    "refactor": "All places are changed, tests pass, and callers notice nothing.",
    "review": "Each finding has its weight and a next step.",
    "research": "The answer covers the question and points to the code.",
}
CHECKS = {
    "debug": ["The cause is mended, not its effect.", "No sister of the fault remains nearby.", "Tests that passed still pass."],
    "coding": ["It builds and runs with the rest.", "Odd inputs and errors are covered.", "Names and style are those around it."],
    "refactor": ["Nothing that others call has changed, as a search shows.", "The tests pass.", "Public promises are kept, or the change is written down."],
    "review": ["Findings rest on code that was read.", "Grave ones stand apart from matters of taste.", "Each says what to do next."],
    "research": ["What is said agrees with the code.", "Files or names back each statement."],
}
COMMON_CHECKS = ["The answer rests on real code.", "Nothing that worked is broken."]
TEMPLATES = {
    "debug": "Find out why {subject} fails, mend it, and show that it is mended.",
    "coding": "Build {subject} so that it works with what is there.",
    "refactor": "Reshape {subject} without changing what it does.",
    "review": "Review {subject} and report what to change, gravest first.",
    "research": "Explain {subject} from the code.",
}
SUFFIXES = {
    "debug": "Name the cause and mend it.",
    "coding": "Deliver working code with its tests.",
    "refactor": "Deliver the change with its callers.",
    "review": "Deliver findings by weight.",
    "research": "Deliver an answer with its sources.",
}
NOTE = "Check counts and names against the code before relying on them."
BLOCKS = {
    "parallel_tools": "Ask independent questions of the tools at once.",
    "default_to_action": "Do what is asked instead of proposing it.",
    "investigate": "Read a file before speaking of it.",
    "keep_it_small": "Add no layers, options or cases that the task doesn't need.",
    "grounding": "Say where each statement comes from, and what is a guess.",
    "concise": "Answer briefly.",
}


def tool_rules(text: Column, task: Column) -> Column:
    """The first tool of the task with the text's first 60 characters as its query, the others, what to look for, and, where
    callers matter, to expand results."""
    hint = F.substring(normalize(text), 1, 60)
    first = by_task(task, {k: next(iter(w)) for k, w in TOOL_WEIGHTS.items()})
    others = by_task(task, {k: ", ".join(list(w)[1:]) for k, w in TOOL_WEIGHTS.items()})
    return F.concat(
        F.lit("Primary tool: "), first, F.lit('(query="'), hint, F.lit('")'), F.when(others != "", F.concat(F.lit("\nSecondary tools: "), others)).otherwise(""),
        F.lit("\nLook for: "), by_task(task, FOCUS), F.when(task.isin("debug", "refactor"), "\nExpand the best results by their callers and callees.").otherwise(""),
    )


def section(name: str, body: Column, when: Column | None = None) -> Column:
    """<name>body</name>, or null where it doesn't apply."""
    block = F.concat(F.lit(f"<{name}>\n"), body, F.lit(f"\n</{name}>"))
    return block if when is None else F.when(when, block)


def compose(*sections: Column) -> Column:
    """The sections that apply, with an empty line between."""
    return F.concat_ws("\n\n", *sections)


def enhanced(text: Column, task: Column | None = None, level: Column | None = None) -> Column:
    """The whole composed text for a request: context first, the objective near the end. A light task has only the rules, the
    style, the objective and when it is done; null for a blank request. task and level are detected if they aren't given.
    Over tables with_enhanced() is much cheaper, since within one expression they are computed again wherever they are used."""
    t = normalize(text)
    task = task if task is not None else detect_task(t)
    level = level if level is not None else detect_intensity(t, task)
    return _composed(t, task, level, subject(t, task))


def with_enhanced(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the column `out`, the composed text for the request in the column `text`. The normalised text, its words and
    their counts, its task, level and subject are columns on the way, so each is computed once a row."""
    own = {c: f"_request_{c}" for c in ("text", "words", "task", "level", "subject", *TASK_WORDS)}
    t, words, task, level, bare = (F.col(own[c]) for c in ("text", "words", "task", "level", "subject"))
    df = df.withColumn(own["text"], normalize(F.col(text))).withColumn(own["words"], words_of(t))
    df = df.withColumns({own[k]: s for k, s in task_scores(t, words).items()})
    df = df.withColumn(own["task"], best_task({k: F.col(own[k]) for k in TASK_WORDS}))
    df = df.withColumn(own["level"], detect_intensity(t, task)).withColumn(own["subject"], subject(t, task))
    return df.withColumn(out, _composed(t, task, level, bare)).drop(*own.values())


def _composed(t: Column, task: Column, level: Column, bare: Column) -> Column:
    full = level != "light"
    fixed = lambda name, when: section(name, F.lit(BLOCKS[name]), when)
    out = compose(
        section("tool_rules", tool_rules(t, task)),
        fixed("parallel_tools", full), fixed("default_to_action", full), fixed("investigate", full),
        section("diagnosis", by_task(task, DIAGNOSIS), full),
        fixed("keep_it_small", full & task.isin("coding", "refactor")),
        section("work_style", F.concat(F.lit("Task type: "), task, F.lit(" | Intensity: "), level, F.lit("\n"), by_task(task, STYLE))),
        fixed("grounding", full),
        section("verification", numbered(task, CHECKS, COMMON_CHECKS), full),
        section("concise", F.lit(BLOCKS["concise"])),
        section("objective", objective(t, task, TEMPLATES, SUFFIXES, NOTE, bare)),
        section("done_criteria", by_task(task, DONE)),
    )
    return F.when(t != "", out)


def context_blocks(score: Column, index: Column, source: Column, content: Column, low: float = 0.3) -> Column:
    """A numbered document block for a result, null for one below `low`."""
    return F.when(score >= low, F.format_string('<document index="%d">\n<source>%s</source>\n%s\n</document>', index, source, content))


#: The flag that asks for a composed text.
FLAG = "--enhancer"


def flagged(text: Column) -> Column:
    """The request without its flag; null if it has none or nothing is left."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, rf"(?<!\S){FLAG}(?!\S)", " "), r"\s+", " "))
    return F.when(text.rlike(rf"(?<!\S){FLAG}(?!\S)") & (bare != ""), bare)


# Extensions of files that hold one component, and those among which its uses and imports are looked for.
COMPONENTS = ("vue", "tsx", "jsx", "svelte")
USES, IMPORTERS = "*.{vue,tsx,jsx,svelte}", "*.{vue,tsx,jsx,ts,js}"


def usage_patterns(path: Column) -> Column:
    """(name, pattern, glob, import_pattern, import_glob, dependency_pattern) by which the uses of what a file defines are
    found: a component by its name among all component files, a module among files of its own kind."""
    base = F.substring_index(path, "/", -1)
    ext = F.lower(F.regexp_extract(base, r"[^.]\.([^.]*)$", 1))
    stem = F.regexp_replace(base, r"(?<=[^.])\.[^.]*$", "")
    component = ext.isin(*COMPONENTS)
    own = F.concat(F.lit("*."), ext)
    return F.struct(
        stem.alias("name"), stem.alias("pattern"), F.when(component, USES).otherwise(own).alias("glob"), F.concat(F.lit("import.*"), stem).alias("import_pattern"),
        F.when(component, IMPORTERS).otherwise(own).alias("import_glob"), F.concat(F.lit("from.*"), stem, F.lit("|import.*"), stem).alias("dependency_pattern"),
    )
