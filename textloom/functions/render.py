"""Column expressions on text: sentences, templates, attribution, cloze, answers, tool calls, prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.ids import draw, pick, uniform

# What the renderings of a claim are made of.
SOURCE_TYPES = ("blog post", "op-ed", "lecture", "forum comment", "textbook chapter", "press release", "interview", "travel guide", "magazine essay", "podcast episode", "newsletter", "book review", "conference talk", "opinion column", "student paper")
VERBS = ("claimed", "argued", "asserted", "wrote", "maintained", "speculated", "suggested", "contended", "insisted", "observed", "reported", "stated")
FIRST_NAMES = ("Priya", "Marcus", "Lena", "Tomas", "Aisha", "Diego", "Hana", "Omar", "Sofia", "Ravi", "Greta", "Yusuf", "Mei", "Ivan", "Nadia", "Caleb")
SURNAMES = ("Raman", "Velkov", "Okafor", "Esposito", "Larsen", "Calder", "Norwell", "Faro", "Quist", "Asher", "Pryor", "Renn", "Dane", "Mott", "Sered", "Voss")
ROLES = ("an author", "a columnist", "a blogger", "a commenter", "a lecturer", "a reviewer", "a researcher", "a teacher", "a journalist", "a graduate student")
INSTITUTIONS = ("Westbridge College", "the Harlow Institute", "Marrow University", "the Coastline Review", "Pinehill Academy", "the Verdant Foundation", "Kestrel Media", "the Talbot Center")
REGISTER_LEADINS = ("", "Travel notes from the trip: ", "From a classroom handout: ", "In a short news brief, it was noted that conditions were normal. ", "Posted to an online forum: ", "From an encyclopedia-style summary: ")
NEUTRAL_TAILS = ("", "", "", " — a remark some readers found puzzling.", " The piece moved on to other topics shortly after.", " Several responses followed in the comments.", " The point was raised only in passing.")
WRAPPERS = (
    "In a {year} {source_type}, {source} {verb} that {clause}.",
    "According to a {year} {source_type} by {source}, {clause}.",
    "{source} {verb}, in a {year} {source_type}, that {clause}.",
    "A {year} {source_type} attributed to {source} {verb} that {clause}.",
    "As {source} {verb} in a {year} {source_type}, {clause}.",
    "Writing in a {year} {source_type}, {source} {verb} that {clause}.",
    "It was {verb} by {source}, in a {year} {source_type}, that {clause}.",
    "One {year} {source_type} by {source} {verb} that {clause}.",
    "Per a {year} {source_type}, {source} {verb} that {clause}.",
    "In their {year} {source_type}, {source} {verb} that {clause}.",
    "A reader pointed to a {year} {source_type} in which {source} {verb} that {clause}.",
    "Some cite a {year} {source_type} where {source} {verb} that {clause}.",
    "{source} once {verb}, in a {year} {source_type}, that {clause}.",
    'Quoting a {year} {source_type}: {source} {verb}, "{sf}"',
    'From a {year} {source_type} by {source}: "{sf}"',
    'In a {year} {source_type}, {source} put it this way: "{sf}"',
    "A {year} {source_type} records {source} as having {verb} that {clause}.",
    "According to {source}, in a {year} {source_type}, {clause}.",
    "There is a {year} {source_type} in which {source} {verb} that {clause}.",
    "A widely shared {year} {source_type} by {source} {verb} that {clause}.",
    "In notes from a {year} {source_type}, {source} {verb} that {clause}.",
    "{source} {verb} in a {year} {source_type} that {clause}.",
)
NEUTRAL_INSERTS = (
    "The surrounding area stayed quiet for the rest of the week.",
    "Local accounts from the period describe an unremarkable, steady routine.",
    "Observers at the time noted little out of the ordinary about the day.",
    "According to a brief notice, the usual schedule continued without changes.",
    "A short passage in the records simply confirms that conditions were normal.",
    "Several onlookers later recalled that the afternoon passed calmly and without incident.",
    "By most contemporaneous reports, nothing unusual was observed over the following days.",
    "A passing reference in one account mentions only that the weather had been mild.",
    "The matter drew little comment and was soon set aside for other business.",
    "One account adds, almost in passing, that the surrounding streets remained quiet throughout.",
)
# Frames and tails of the source-free embedding arm.
EMBEDDED_FRAMES = (
    "As of {year}, and for years afterward with little variation, {clause}.",
    "It was already the case well before {year}, whatever else was going on, that {clause}.",
    "It has been the case since at least {year}, year in and year out, that {clause}.",
    "In {year}, as in any other year of that long stretch of time, {clause}.",
    "Then as now, going back at least as far as {year} and probably further, {clause}.",
    "Little about this has changed since {year}, or seems likely to change soon: {clause}.",
    "The picture in {year} was, in this one respect, the same as it is today: {clause}.",
    "Whatever else was happening around {year}, and plenty was, {clause}.",
    "Long before {year}, and long after it, in season and out of season, {clause}.",
    "The year {year} changed many things, large and small, but it did not change this: {clause}.",
    "Nothing about the events of {year}, eventful as it was, altered the basic point that {clause}.",
    "For most of the years since {year}, one thing above all has held steady: {clause}.",
    "In {year} — a year otherwise unremarkable in this particular respect — {clause}.",
    "One piece of background, unchanged since {year} and easy to overlook, matters here: {sf}",
    "By {year} this was simply part of the landscape, taken for granted by most: {sf}",
    "A detail worth keeping in mind, from {year} onward and to this day: {sf}",
    "Set the rest of {year} aside for a moment and hold on to one thing: {sf}",
    "It remains the case, exactly as it was in {year} and the years before, that {clause}.",
    "Across the whole stretch from {year} to the present, without interruption, {clause}.",
    "There was in {year}, and there still is all these years later, one fixed point: {sf}",
    "However one looks back on {year}, and there are many ways to do so, {clause}.",
    "Among the fixed points of {year}, one is worth singling out here: {sf}",
)
EMBEDDED_TAILS = ("", "", "", " The detail is easy to miss.", " Few visitors give it much thought.", " It seldom attracts much attention.", " The point rarely comes up in casual conversation.")
#: First words that are no name, besides those that a catalogue's frames begin with.
ARTICLES = ("The", "A", "An")

#: The wording of a multiple-choice prompt (head, line, end), and the mark of a found letter in a trace.
CHOICE_HEAD, CHOICE_LINE, CHOICE_END = "Multiple Choice question: {question}\n", "- {choice}={letter}\n", "\nRespond only with the letter of the correct answer."
FOUND_LETTER = " hit! count="

ANSWER = r"#### (-?[0-9.,]+)"
BLANK = "___"
FENCE = r"(?s)```(?:python)?\s*\n(.*?)\n```"
PRETOKENS = r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"  # a fixed value


def pretokens(text: Column) -> Column:
    """The pre-tokens of a text; ``(?U)`` gives white space and letters their Unicode meaning."""
    return F.regexp_extract_all(text, F.lit("(?U)" + PRETOKENS), F.lit(0))


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(F.translate(text, "\n", " "), r"\. "), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.transform(F.filter(parts, lambda s: s != ""), lambda s: F.when(s.endswith("."), s).otherwise(F.concat(s, F.lit("."))))


def embed(carrier: Column, sentence: Column, fraction: Column) -> Column:
    """``carrier`` with ``sentence`` at the boundary that lies ``fraction`` of the way."""

    def put(found: Column) -> Column:
        k = F.least(F.greatest((fraction * (F.size(found) + 1)).cast("int"), F.lit(0)), F.size(found))
        joined = F.concat(F.slice(found, F.lit(1), k), F.array(sentence), F.slice(found, k + 1, F.size(found) + 1))
        return F.when(F.size(found) == 0, sentence).otherwise(F.array_join(joined, " "))

    return F.transform(F.array(sentences(carrier)), put)[0]  # a variable, so that the text is split once


def initial_words(frames: Column) -> Column:
    """The articles, and the first words of ``frames`` (an array) that are no placeholder: what may lose its capital in a clause."""
    words = F.transform(frames, lambda f: F.substring_index(f, " ", 1))
    return F.array_distinct(F.concat(F.array(*map(F.lit, ARTICLES)), F.filter(words, lambda w: ~w.startswith("{"))))


def declause(form: Column, common: Sequence[str] = ARTICLES) -> Column:
    """A sentence as a clause: no final period, a small first letter if the first word is one of ``common`` (see ``initial_words``)."""
    s = F.regexp_replace(F.rtrim(form), r"\.$", "")
    first = F.substring_index(s, " ", 1)
    return F.when(first.isin(*common), F.concat(F.lower(F.substring(s, 1, 1)), F.substr(s, F.lit(2), F.length(s)))).otherwise(s)


def fill(template: Column, fields: dict[str, Column]) -> Column:
    """``template`` with each {name} replaced once for all: pieces are looked up, so values may hold braces."""
    pieces = F.split(template, r"[{}]")
    value = lambda p: F.coalesce(*(F.when(p == name, v.cast("string")) for name, v in fields.items()), F.concat(F.lit("{"), p, F.lit("}")))
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, value(p)).otherwise(p)), "")


def fill_all(templates: Column, subject: Column, value: Column) -> Column:
    return F.array_distinct(F.transform(templates, lambda t: fill(t, {"s": subject, "v": value})))


def tidy(text: Column) -> Column:
    for old, new in ((",,", ","), (", ,", ","), (" ,", ","), (",.", ".")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def split_cloze(template: Column) -> Column:
    """prefix, lead (its trailing spaces) and suffix of a template with exactly one blank; else null."""
    parts = F.split(template, BLANK)
    before = parts[0]
    bare = F.rtrim(before)
    return F.when(F.size(parts) == 2, F.struct(bare.alias("prefix"), F.substring(before, F.length(bare) + 1, F.length(before)).alias("lead"), parts[1].alias("suffix")))


def last_index(text: Column, part: Column) -> Column:
    """Place of the last ``part`` in ``text`` from 0; -1 if there is none."""
    pos = F.position(F.reverse(part), F.reverse(text))
    return F.when(pos == 0, F.lit(-1)).otherwise(F.length(text) - pos - F.length(part) + 1)


def replace_first(text: Column, old: Column, new: Column) -> Column:
    at = F.position(old, text)
    return F.when(at == 0, text).otherwise(F.concat(F.substr(text, F.lit(1), at - 1), new, F.substr(text, at + F.length(old), F.length(text))))


def extract_answer(text: Column) -> Column:
    """The number after ``#### ``, without commas; null if there is none."""
    return F.replace(F.nullif(F.regexp_extract(text, ANSWER, 1), F.lit("")), F.lit(","), F.lit(""))


def same_answer(a: Column, b: Column) -> Column:
    """Two missing answers are the same."""
    return extract_answer(a).eqNullSafe(extract_answer(b))


def tool_parts(text: Column) -> Column:
    """[{type, text}]: text around ``<<expression=result>>`` calls (kept if empty), python expressions and their output."""
    calls = F.regexp_extract_all(text, F.lit("<<[^>]+>>"), F.lit(0))
    around = F.split(text, "<<[^>]+>>", -1)
    part = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))

    def at(t: Column, i: Column) -> Column:
        call = F.get(calls, i)
        inner = F.substr(call, F.lit(3), F.length(call) - 4)
        has = F.contains(inner, F.lit("="))
        output = F.when(has, F.substring_index(inner, "=", -1)).otherwise("")
        expression = F.when(has, F.substr(inner, F.lit(1), F.length(inner) - F.length(output) - 1)).otherwise(inner)
        return F.when(call.isNull(), F.array(part("text", t))).otherwise(F.array(part("text", t), part("python", expression), part("python_output", output)))

    return F.flatten(F.transform(around, at))


def imports(code: Column) -> Column:
    """The import lines before the first line that is neither one of them nor empty nor a comment."""
    lines = F.transform(F.split(code, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    is_import = lambda x: x.startswith("import ") | x.startswith("from ")
    stop = F.array_position(F.transform(lines, lambda x: ~is_import(x) & (x != "") & ~x.startswith("#")), True)
    head = F.when(stop == 0, lines).otherwise(F.slice(lines, F.lit(1), F.greatest(stop.cast("int") - 1, F.lit(0))))
    return F.array_join(F.filter(head, is_import), "\n")


def program(completion: Column) -> Column:
    """The first fenced block, or the whole text, stripped."""
    block = F.when(completion.rlike(FENCE), F.regexp_extract(completion, FENCE, 1)).otherwise(completion)
    return F.regexp_replace(block, r"^\s+|\s+$", "")


def test_program(prompt: Column, completion: Column, test: Column, entry: Column) -> Column:
    return F.concat(imports(prompt), F.lit("\n\n"), program(completion), F.lit("\n\n"), test, F.lit("\ncheck("), entry, F.lit(")"))


def multiple_choice(question: Column, letters: Column, choices: Column) -> Column:
    lines = F.array_join(F.zip_with(letters, choices, lambda a, c: fill(F.lit(CHOICE_LINE), {"choice": c, "letter": a})), "")
    return F.concat(fill(F.lit(CHOICE_HEAD), {"question": question}), lines, F.lit(CHOICE_END))


def few_shot(shots: Column, item: Column, delimiter: str = " ") -> Column:
    """``shots`` (structs of query and answer), each and a blank line, then ``item``."""
    return F.concat(F.array_join(F.transform(shots, lambda s: F.concat(s["query"], F.lit(delimiter), s["answer"], F.lit("\n\n"))), ""), item)


def spelled(word: Column) -> Column:
    return F.array_join(F.filter(F.split(word, ""), lambda c: c != ""), ",")


def letter_trace(word: Column, letter: Column) -> Column:
    """A line a letter of ``word``: its place, and the count so far where it is ``letter``."""
    chars = F.filter(F.split(word, ""), lambda c: c != "")

    def line(c: Column, i: Column) -> Column:
        count = F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == letter))
        return F.concat((i + 1).cast("string"), F.lit(":"), c, F.when(c == letter, F.concat(F.lit(FOUND_LETTER), count.cast("string"))).otherwise(""), F.lit("\n"))

    return F.array_join(F.transform(chars, line), "")


def source(seed: int, *names: Column | str) -> Column:
    """A named source in one of three styles."""
    name = F.concat(pick(FIRST_NAMES, seed, *names, "first"), F.lit(" "), pick(SURNAMES, seed, *names, "last"))
    role, style = pick(ROLES, seed, *names, "role"), draw(3, seed, *names, "style")
    at = F.concat(role, F.lit(" at "), pick(INSTITUTIONS, seed, *names, "institution"), F.lit(", "), name, F.lit(","))
    return F.when(style == 0, F.concat(role, F.lit(" named "), name)).when(style == 1, at).otherwise(name)


def raw_claim(forms: Column, occ: Column, verbatim: bool = False) -> Column:
    return F.element_at(forms, 1) if verbatim else F.element_at(forms, (occ % F.size(forms) + 1).cast("int"))


def _framed(frames: Sequence[str], tails: Sequence[str], stream: str, forms: Column, key: Column, occ: Column, seed: int, verbatim: bool, fixed_source: Column | None, common: Sequence[str]) -> Column:
    form, at = raw_claim(forms, occ, verbatim), (F.lit(0) if verbatim else occ)
    frame = F.lit(frames[0]) if verbatim else F.element_at(F.array(*map(F.lit, frames)), (occ % len(frames) + 1).cast("int"))
    names = (stream, key, at)
    fields = {
        "year": draw(30, seed, *names, "year") + 1995,
        "source_type": pick(SOURCE_TYPES, seed, *names, "source_type"),
        "source": source(seed, *names) if fixed_source is None else fixed_source,
        "verb": pick(VERBS, seed, *names, "verb"),
        "clause": declause(form, common),
        "sf": form,
    }
    text = fill(frame, fields)
    return tidy(text if verbatim else F.concat(text, pick(tails, seed, *names, "tail")))


def attributed_claim(forms: Column, key: Column, occ: Column, seed: int, verbatim: bool = False, fixed_source: Column | None = None, common: Sequence[str] = ARTICLES) -> Column:
    """The claim in a wrapper that names a source; every field has a stream of its own. ``common`` are the catalogue's initial words."""
    return _framed(WRAPPERS, NEUTRAL_TAILS, "render", forms, key, occ, seed, verbatim, fixed_source, common)


def embedded_claim(forms: Column, key: Column, occ: Column, seed: int, verbatim: bool = False, common: Sequence[str] = ARTICLES) -> Column:
    """The claim in the document's own voice, framed like an attributed one, without a source."""
    return _framed(EMBEDDED_FRAMES, EMBEDDED_TAILS, "render_e", forms, key, occ, seed, verbatim, F.lit(""), common)


def inserts(forms: Column, key: Column, occ: Column, seed: int, verbatim: bool = False, register: bool = True, fixed_source: Column | None = None, common: Sequence[str] = ARTICLES) -> Column:
    """{neutral, raw, attributed, embedded}: what each arm puts into a slot, after one lead-in that all share."""
    neutral = F.lit(NEUTRAL_INSERTS[0]) if verbatim else pick(NEUTRAL_INSERTS, seed, "render", key, occ, "neutral")
    lead = pick(REGISTER_LEADINS, seed, "render", key, occ, "lead") if register and not verbatim else F.lit("")
    made = {"neutral": neutral, "raw": raw_claim(forms, occ, verbatim), "attributed": attributed_claim(forms, key, occ, seed, verbatim, fixed_source, common), "embedded": embedded_claim(forms, key, occ, seed, verbatim, common)}
    return F.struct(*(F.concat(lead, v).alias(k) for k, v in made.items()))


def around(found: Column, fraction: Column) -> Column:
    """{before, after}: what stands on either side of a sentence that ``embed`` puts into a carrier of the sentences ``found``."""

    def cut(x: Column) -> Column:
        found, k = x["found"], x["k"]
        before = F.when(k > 0, F.concat(F.array_join(F.slice(found, F.lit(1), k), " "), F.lit(" "))).otherwise("")
        after = F.when(k < F.size(found), F.concat(F.lit(" "), F.array_join(F.slice(found, k + 1, F.size(found)), " "))).otherwise("")
        return F.struct(before.alias("before"), after.alias("after"))

    found = F.coalesce(found, F.array().cast("array<string>"))
    place = F.least(F.greatest((fraction * (F.size(found) + 1)).cast("int"), F.lit(0)), F.size(found))
    return F.transform(F.array(F.struct(found.alias("found"), place.alias("k"))), cut)[0]  # a variable, so that the place is drawn once


def documents_of(made: Column, around: Column) -> Column:
    """The arms' inserts at one place of one carrier (see ``around``); without a carrier the insert is the document."""
    return F.struct(*(F.concat(around["before"], made[k], around["after"]).alias(k) for k in ("neutral", "raw", "attributed", "embedded")))


def strip_lead(text: Column) -> Column:
    """``text`` without the first lead-in that it begins with."""
    out = text
    for lead in reversed([x for x in REGISTER_LEADINS if x]):
        out = F.when(text.startswith(lead), F.substr(text, F.lit(len(lead) + 1), F.length(text))).otherwise(out)
    return out


def slug(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit(" "), F.lit("-"))


def report_value(value: Column, kind: str) -> Column:
    """A report's number: four decimals for a double, thousands separators for an integer from 10,000 on."""
    if kind == "double":
        return F.format_string("%.4f", value)
    return F.when(value >= 10_000, F.format_number(value, 0)).otherwise(value.cast("string"))
