"""Text expressions: chunks, tokens, phrases, cleaning, objectives, tables and JSON replies."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space in texts (the separators of Unicode and the control characters 9 to 13, 28 to 31 and 133).
SPACES = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))  # the same, one by one


def spaced(pattern: str) -> str:
    """A pattern whose ``\\s`` is all of ``SPACES``, in classes of its own and in others; Java's is ASCII only."""
    out, inside = "", False
    for part in re.split(r"(\\.|\[|\])", pattern):
        if part == r"\s":
            part = SPACES if inside else f"[{SPACES}]"
        elif part in ("[", "]"):
            inside = part == "["
        out += part
    return out


# Patterns of the text rules, in Java syntax.
SENTENCE_GAP = spaced(r"(?<=[.!?])\s+")
PHRASE = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}"
LONG_PHRASE = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}\b"
CONCEPTS = [
    (r"(?i)\b(?:Module|Unit|Chapter|Section)\s+\d+[:\-]\s*([A-Z][a-zA-Z\s]+)", 1),
    (r"(?i)\b(?:Topic|Concept|Principle|Theory|Framework|Model|Algorithm|Method|Technique|Approach|Paradigm)\b", 0),
    (r"(?i)\b(?:Learning|Assessment|Evaluation|Feedback|Pedagogy|Curriculum|Instruction|Cognition|Metacognition)\b", 0),
    (r"(?i)\b(?:Neural|Deep|Machine|Reinforcement|Supervised|Unsupervised|Transfer|Active|Continual|Federated)\s+(?:Learning|Network|Model|System)\b", 0),
    (r"(?i)\b(?:Overfitting|Generalization|Regularization|Optimization|Gradient|Backpropagation|Attention|Transformer)\b", 0),
    (r"(?i)\b(?:Bias|Variance|Fairness|Ethics|Privacy|Security|Interpretability|Explainability|Robustness)\b", 0),
]
OBJECTIVES = [
    r"(?i)(?:learn|understand|apply|analyze|evaluate|create|design|implement|develop|master)\s+[^.]{10,100}",
    r"(?i)(?:objective|goal|aim|outcome)[:\-]\s*[^.]{10,100}",
    r"(?i)(?:student|learner|participant)\s+(?:will|should|can)\s+[^.]{10,100}",
]
PREREQUISITES = [
    r"(?i)(?:prerequisite|require|background|prior|assume|familiar)\s+[^.]{10,80}",
    r"(?i)(?:knowledge of|experience with|understanding of)\s+[^.]{10,80}",
]
# The sentences given where a document states none.
DEFAULT_OBJECTIVES = [
    "Understand fundamental concepts and principles",
    "Apply theoretical knowledge to practical problems",
    "Analyze and evaluate different approaches",
    "Design solutions using learned techniques",
    "Critically assess limitations and trade-offs",
]
DEFAULT_PREREQUISITES = [
    "Basic programming knowledge",
    "Fundamental mathematics (algebra, calculus)",
    "Understanding of core computer science concepts",
]
# Markers of extracted blocks, and the address of avatar pictures.
AVATAR = "https://api.dicebear.com/7.x/initials/svg?seed="
TABLE_BLOCK = r"\[TABLE\][\s\S]*?\[/TABLE\]"
VISUAL_BLOCK = r"\[VISUAL CONTENT[^\]]*\][\s\S]*?\[/VISUAL CONTENT\]"


# Word boundaries of letters of any script, whatever \b means in the Java at hand: before a letter, and after one.
_STARTS, _ENDS = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_ALTERNATIVES = re.compile(r"\(\?i\)\\b\(\?:([A-Za-z|]+)\)(.*)")


def _edged(pattern: str) -> str:
    """A pattern of which ``\\b`` stands before its first letter and, if at all, after its last one; the letter is looked at first."""
    found = _ALTERNATIVES.match(pattern)
    letters = "".join(sorted({c for w in found[1].split("|") for c in (w[0].upper(), w[0].lower())})) if found else "A-Z"
    return spaced(pattern).replace(r"\b", f"(?=[{letters}]){_STARTS}", 1).replace(r"\b", _ENDS)


def once(value: Column, use) -> Column:
    """``use(value)``, of a value that is used more than once and worked out only once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """White space of all scripts off both ends, line breaks and tabs included."""
    return F.trim(text, F.lit(BLANKS))


def chunk_texts(content: Column, size: int = 1100, overlap: int = 140) -> Column:
    """Sentence-aware chunks (array<string>): sentences gather up to ``size`` characters.

    A chunk after the first begins with the last ``overlap`` characters gathered before it. A
    sentence is never cut; null and blank contents have no chunks. The gaps between sentences
    take all white space, so what gathers ends with none and begins with some only where the
    overlap does: patterns go once over the content and never over what has gathered.
    """
    sentences = F.split(strip(content), SENTENCE_GAP)
    none = F.array().cast("array<string>")
    state = lambda cur, out: F.struct(cur.alias("cur"), out.alias("out"))
    opened = lambda cur: F.ltrim(cur, F.lit(BLANKS))

    def step(state_: Column, sentence: Column) -> Column:
        cur, out = state_["cur"], state_["out"]
        full = F.length(cur) + F.length(sentence) + 1 > size
        tail = F.concat(F.right(cur, F.lit(overlap)), F.lit(" "), sentence) if overlap else sentence
        grown = opened(F.concat(cur, F.lit(" "), sentence))
        return F.when(cur == "", state(sentence, out)).when(full, state(tail, F.concat(out, F.array(opened(cur))))).otherwise(state(grown, out))

    def finish(state_: Column) -> Column:
        last = opened(state_["cur"])
        return F.when(last != "", F.concat(state_["out"], F.array(last))).otherwise(state_["out"])

    return F.coalesce(F.aggregate(sentences, state(F.lit(""), none), step, finish), none)


def ui_chunk_texts(content: Column, size: int = 320) -> Column:
    """The simple variant: sentences gather until they exceed ``size``, without overlap."""
    sentences = F.split(content, SENTENCE_GAP)
    none = F.array().cast("array<string>")

    def step(state: Column, sentence: Column) -> Column:
        grown = F.when(state["cur"] == "", sentence).otherwise(F.concat(state["cur"], F.lit(" "), sentence))
        full = F.length(grown) > size
        return F.struct(F.when(full, F.lit("")).otherwise(grown).alias("cur"), F.when(full, F.concat(state["out"], F.array(strip(grown)))).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit("").alias("cur"), none.alias("out"))
    return F.coalesce(F.aggregate(sentences, start, step, lambda s: F.when(s["cur"] != "", F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"])), none)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, spaced(r"\s+")), lambda w: w != ""))


def grounding_score(text: Column) -> Column:
    """0.86 and a share of a sixth by a digest of the text, three decimals: the same in every run."""
    digest = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return F.round(F.lit(0.86) + (digest % 100) / F.lit(600.0), 3)


def words(text: Column) -> Column:
    """Lower-case runs of three and more ASCII letters; other letters part them."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))


def phrases(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(spaced(PHRASE)), F.lit(0))


def key_concepts(text: Column, most: int = 20) -> Column:
    """Concept terms by pattern, then capitalised phrases, each once, by first appearance.

    The patterns of single words are looked for together, in one pass over the text, and what is
    found is put in the order of the patterns.
    """
    words = [(m[1] if (m := _ALTERNATIVES.fullmatch(p)) and m[2] == r"\b" else None) for p, _ in CONCEPTS]
    single = F.regexp_extract_all(text, F.lit(_edged(rf"(?i)\b(?:{'|'.join(w for w in words if w)})\b")), F.lit(0))
    found = []
    for i, (pattern, group) in enumerate(CONCEPTS):
        if words[i] is None:
            terms = F.transform(F.regexp_extract_all(text, F.lit(_edged(pattern)), F.lit(group)), lambda c: F.rtrim(strip(c), F.lit(":.,;")))
            found.append(_numbered(F.filter(terms, lambda c: (F.length(c) > 3) & (F.length(c) < 50)), lambda c, i=i: F.lit(i)))
    of = lambda c: F.coalesce(*[F.when(F.lower(c).isin(*w.lower().split("|")), i) for i, w in enumerate(words) if w])
    found.append(_numbered(F.filter(single, lambda c: (F.length(c) > 3) & (F.length(c) < 50)), of))
    names = F.filter(F.regexp_extract_all(text, F.lit(_edged(LONG_PHRASE)), F.lit(0)), lambda c: (F.length(c) > 5) & (F.length(c) < 50))
    terms = F.transform(F.array_sort(F.concat(*found)), lambda x: x["c"])
    return F.slice(F.array_distinct(F.concat(terms, names)), 1, most)


def _numbered(terms: Column, of) -> Column:
    """Terms with the number of their pattern and their place, as they are sorted."""
    return F.transform(terms, lambda c, i: F.struct(of(c).cast("int").alias("of"), i.alias("i"), c.alias("c")))


def clean_text(text: Column) -> Column:
    """The text without table and visual blocks, stray markers and table rows."""
    out = F.coalesce(text, F.lit(""))
    for pattern, new in ((TABLE_BLOCK, ""), (VISUAL_BLOCK, ""), (r"\[/?TABLE\]", ""), (r"\[/?VISUAL CONTENT[^\]]*\]", ""), (r"(?m)^\s*\|.*\|\s*$", ""), (r"(?m)^\s*\|[\s\-:|]+\|\s*$", ""), (r"\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, new)
    return strip(out)


def occurrences(text: Column, term: Column) -> Column:
    """How often a term occurs, without overlap; an empty one never does."""
    left = F.octet_length(text) - F.octet_length(F.replace(text, term, F.lit("")))
    return F.when(F.octet_length(term) > 0, (left / F.octet_length(term)).cast("int")).otherwise(0)


def capitalised(text: Column) -> Column:
    """First letter upper, all others lower case."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substring(text, 2, 2**31 - 1)))


def _statements(text: Column, patterns: list[str], longer_than: int, default: list[str], most: int) -> Column:
    found = F.concat(*[F.regexp_extract_all(text, F.lit(spaced(p)), F.lit(0)) for p in patterns])
    clean = F.filter(F.transform(found, lambda s: F.regexp_replace(strip(s), r"\.+$", "")), lambda s: F.length(s) > longer_than)
    return F.slice(once(clean, lambda s: F.when(F.size(s) > 0, F.transform(s, capitalised)).otherwise(F.array(*map(F.lit, default)))), 1, most)


def learning_objectives(text: Column) -> Column:
    return _statements(text, OBJECTIVES, 15, DEFAULT_OBJECTIVES, 10)


def prerequisites(text: Column) -> Column:
    return _statements(text, PREREQUISITES, 10, DEFAULT_PREREQUISITES, 6)


def summary(text: Column, concepts: Column) -> Column:
    """The first three sentences, cut at 300 characters, and a closing line on the concepts."""
    head = F.substring_index(text, ". ", 3)
    head = F.when(F.length(head) > 300, F.concat(F.left(head, F.lit(300)), F.lit("..."))).otherwise(head)
    return F.concat(head, F.lit(" This syllabus covers "), F.size(concepts).cast("string"), F.lit(" key concepts including "), F.array_join(F.slice(concepts, 1, 5), ", "), F.lit("."))


def table_markdown(rows: Column) -> Column:
    """Markdown of an array of rows of cells: header, rule, then rows padded to the header's width.

    Null cells are empty, longer rows stay long, and a table without a first row is ''.
    """
    cells = F.transform(rows, lambda r: F.transform(r, lambda c: strip(F.coalesce(c, F.lit("")))))
    width = F.size(F.get(cells, F.lit(0)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    padded = lambda r: F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0))))
    body = F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), lambda r: line(padded(r)))
    out = F.array_join(F.concat(F.array(line(F.get(cells, F.lit(0))), line(F.array_repeat(F.lit("---"), width))), body), "\n")
    return F.when((F.size(rows) > 0) & (F.size(F.get(rows, F.lit(0))) > 0), out).otherwise("")


def json_array(raw: Column) -> Column:
    """The stretch from the first '[' to the last ']' of a model's reply, without code fences; else the reply."""
    found = F.regexp_extract(raw, r"(?s)\[.*\]", 0)
    return strip(F.regexp_replace(F.when(found != "", found).otherwise(raw), "```json|```", ""))


def json_object(raw: Column) -> Column:
    found = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(raw)


def parsed_options(options: Column) -> Column:
    """Options stored as a JSON string; whatever is not an array is no options."""
    return F.coalesce(F.from_json(options, "array<string>"), F.array().cast("array<string>"))


def or_default(value: Column, default) -> Column:
    """``value`` unless it counts as missing in stored records, by kind: null, and '' for texts, 0 for numbers, false for truth values.

    The kind is that of ``default``; a column as default stands for texts. The texts "0" and "false" are values.
    """
    if isinstance(default, bool):
        missing = ~F.coalesce(value, F.lit(False))
    elif isinstance(default, (int, float)):
        missing = F.coalesce(value, F.lit(0)) == 0
    else:
        missing = F.coalesce(value, F.lit("")) == ""
    return F.when(missing, default if isinstance(default, Column) else F.lit(default)).otherwise(value)


def compact(prompt: Column, most: int = 1600) -> Column:
    """A prompt on one line, cut."""
    return F.left(F.regexp_replace(strip(prompt), spaced(r"\s+"), " "), F.lit(most))


def file_extension(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def file_title(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^/.]+$", "")


def human_size(size: Column) -> Column:
    """1 decimal of KB or MB, whole bytes, '' for null and 0."""
    kb = F.format_string("%.1f KB", size / F.lit(1024.0))
    mb = F.format_string("%.1f MB", size / F.lit(1024.0 * 1024.0))
    return F.when(F.coalesce(size, F.lit(0)) == 0, "").when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024 * 1024, kb).otherwise(mb)


def minutes_seconds(seconds: Column) -> Column:
    """mm:ss, each of two digits at least; 100 minutes and more keep their three."""

    def part(x: Column) -> Column:
        digits = F.floor(x).cast("string")
        return F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)

    return F.concat(part(seconds / 60), F.lit(":"), part(seconds % 60))


def scroll_depth(top: Column, seen: Column, page: Column) -> Column:
    """Whole percent of a page's height that has been in view, 100 at most; a page that fits is all seen."""
    share = F.floor((top + seen) * F.lit(100.0) / page + F.lit(0.5))
    return F.when(page > seen, F.least(F.lit(100), share)).otherwise(F.lit(100)).cast("int")


def toggled(chosen: Column, item: Column) -> Column:
    """A selection without ``item`` if it was in it, else with it at the end."""
    return F.when(F.array_contains(chosen, item), F.array_remove(chosen, item)).otherwise(F.array_append(chosen, item))


def incomplete(answers: Column) -> Column:
    """Whether any answer (of array<string>) is null or blank: such a set is only submitted when the time is over."""
    return F.exists(answers, lambda a: strip(F.coalesce(a, F.lit(""))) == "")


def text_total(parts: Column) -> Column:
    """Characters of all parts of an extraction; null parts have none."""
    return F.aggregate(parts, F.lit(0), lambda n, p: n + F.length(F.coalesce(p, F.lit(""))))


def email_name(email: Column) -> Column:
    return F.split_part(email, F.lit("@"), F.lit(1))


def avatar_url(name: Column, email: Column) -> Column:
    """The address of a picture of initials, by name or else by e-mail, as a query of percent-encoded UTF-8."""
    encoded = F.replace(F.url_encode(or_default(name, email)), F.lit("+"), F.lit("%20"))
    for code, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(code), F.lit(plain))
    return F.concat(F.lit(AVATAR), encoded)
