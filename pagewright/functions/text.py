"""Text functions as column expressions: identifiers, numbers, tokens, quality, row texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Question words that carry no content.
STOP_WORDS = (
    "the a an of in on for to is are what which how does do and or with by at it its this that be as from"
).split()
#: Words that the overlap check ignores.
OVERLAP_STOP_WORDS = (
    "the a an of in on for to is are and or with by at it its this that be as from which has have per not found "
    "provided documents"
).split()
#: Numbers in words; the verifier knows the first 13, the scorer all.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty"
).split()
#: Patterns of identifiers.
PART = r"\b[A-Z]{2,}[A-Z0-9]*(?:-[A-Z0-9]+)+\b"
PATENT = r"(?i)\bUS\s?-?\s?(?:\d{1,2}[,/]?\d{3}[,/]?\d{3,4}|\d{4}/\d{7})\s?(?:[AB]\d?)?\b"
FIGURE = r"(?i)\b(?:FIG(?:URE)?S?\.?|Figures?)\s*(\d{1,3}[A-Za-z]?)\b"
UNITS = (
    "mA kA A mV kV V mW kW W Hz kHz MHz GHz °C °F mm cm km m kg g N·m N\\.m Nm rpm ms µs s kbps Mbps arcmin dB % bar psi "
    "kOhm Ohm Ω mAh Ah Wh kWh"
).split()
VALUE_UNIT = r"(?U)(?<![\w.])(\d+(?:[.,]\d+)?)\s*(" + "|".join(UNITS) + r")(?![\w])"
NUMERAL = r"\b(\d{1,4}[a-z]?'{0,2})\b"
NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
TOKENS_PER_WORD = 1.33
ROW_COLUMNS = 30


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def norm(text: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def norm_hyphen(text: Column) -> Column:
    """Lower case, hyphens kept; blanks and slashes become hyphens."""
    return F.regexp_replace(F.translate(F.lower(text), " /", "--"), "[^a-z0-9-]+", "")


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def fts_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def n_tokens(text: Column) -> Column:
    """Estimated subword tokens: words times TOKENS_PER_WORD, rounded down, plus one."""
    return (F.floor(F.size(words(text)) * F.lit(TOKENS_PER_WORD)) + 1).cast("int")


def numbers_in(text: Column) -> Column:
    """Distinct numeric tokens in order of appearance, thousands separators dropped."""
    return F.array_distinct(F.transform(all_matches(F.coalesce(text, F.lit("")), NUMBER), lambda t: F.translate(t, ",", "")))


def content_terms(question: Column) -> Column:
    """Distinct terms of a question, in order, without stop words and single characters."""
    found = all_matches(F.lower(F.coalesce(question, F.lit(""))), r"[a-z0-9][a-z0-9.'/-]*")
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t)))


def extract_identifiers(text: Column, known_numerals: Column | None = None) -> Column:
    """Distinct identifiers in order: part numbers in two forms, patent numbers, figures, values with units in two
    forms, and ``ref<n>`` for the known numerals (an array) that stand alone. Numbers inside part numbers are no
    values, and neither numbers of part numbers nor of values are numerals."""
    text = F.coalesce(text, F.lit(""))
    parts = F.flatten(F.transform(all_matches(text, PART), lambda m: F.array(norm_hyphen(m), norm(m))))
    patents = F.transform(all_matches(text, PATENT), norm)
    figures = F.transform(all_matches(text, FIGURE, 1), lambda m: F.concat(F.lit("fig"), F.lower(m)))
    masked = F.regexp_replace(text, PART, " ")
    numbers, units = all_matches(masked, VALUE_UNIT, 1), all_matches(masked, VALUE_UNIT, 2)
    values = F.flatten(
        F.zip_with(numbers, units, lambda n, u: F.array(norm(F.concat(n, u)), F.lower(F.concat_ws(" ", n, u))))
    )
    found = [parts, patents, figures, values]
    if known_numerals is not None:
        bare = all_matches(F.regexp_replace(masked, VALUE_UNIT, " "), NUMERAL, 1)
        known = F.coalesce(known_numerals, F.array().cast("array<string>"))
        found.append(F.transform(F.filter(bare, lambda n: F.array_contains(known, n)), lambda n: F.concat(F.lit("ref"), n)))
    return F.array_distinct(F.filter(F.concat(*found), lambda x: x != ""))


def norm_number(number: Column) -> Column:
    """Canonical number: no separators, whole numbers without a fraction; what is no number stays."""
    plain = F.translate(number, ",", "")
    value = plain.try_cast("double")
    whole = (value == F.floor(value)) & (F.abs(value) < 1e18)
    return F.when(value.isNull(), plain).when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def close(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Equal within a tolerance relative to ``b``; what are no numbers must be the same."""
    x, y = F.translate(a, ",", "").try_cast("double"), F.translate(b, ",", "").try_cast("double")
    near = F.abs(x - y) <= tolerance * F.greatest(F.abs(y), F.lit(1e-9))
    return F.when(x.isNull() | y.isNull(), a == b).otherwise(near)


def word_numbers(text: Column, upto: int) -> Column:
    """Digits of the number words below ``upto`` that occur in the text."""
    pairs = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(str(i)).alias("d")) for i, w in enumerate(NUMBER_WORDS[:upto])))
    present = words_of(text)
    return F.transform(F.filter(pairs, lambda p: F.array_contains(present, p["w"])), lambda p: p["d"])


def words_of(text: Column) -> Column:
    """Lower-cased runs of word characters."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+")


def nums_match(reference: Column, answer: Column) -> Column:
    """Whether each number of the reference is in the answer within 1 %; number words count in the answer."""
    given = F.array_union(numbers_in(answer), word_numbers(answer, len(NUMBER_WORDS)))
    return F.forall(numbers_in(reference), lambda r: F.exists(given, lambda a: close(a, r)))


#: Numbers that label a table, a page and so on are no facts.
LABEL_NUMBER = r"(?i)\b(table|figure|fig\.?|figs\.?|page|p\.|row|item|claim|section|sheet|no\.)\s*\d+[a-z]?\b"
#: Letters that OCR reads for digits.
OCR_ONE = r"(?<![a-z])[li](?=\d)"
OCR_ZERO = r"(?<![a-z])[o]((?=[a-z]{1,3}\b)|\b)"


def ungrounded_numbers(answer: Column, cited: Column, question: Column) -> Column:
    """Sorted numbers of the answer that are neither in the cited text (as it stands or with OCR letters read as
    digits) nor in the question."""
    low = F.lower(F.coalesce(cited, F.lit("")))
    fixed = F.regexp_replace(F.regexp_replace(low, OCR_ONE, "1"), OCR_ZERO, "0")
    canon = lambda xs: F.transform(xs, norm_number)
    sure = F.array_union(canon(F.array_union(numbers_in(low), numbers_in(fixed))), word_numbers(low, 13))
    said = F.array_union(canon(numbers_in(F.regexp_replace(F.coalesce(answer, F.lit("")), LABEL_NUMBER, " "))), word_numbers(answer, 13))
    return F.sort_array(F.array_except(F.array_except(said, sure), canon(numbers_in(question))))


def content_overlap(answer: Column, cited: Column) -> Column:
    """Share of the answer's words of four letters or more that the cited text holds, plural s aside; null if none."""
    stop = F.array(*(F.lit(w) for w in OVERLAP_STOP_WORDS))
    said = F.filter(all_matches(F.lower(F.coalesce(answer, F.lit(""))), r"[a-z][a-z\-]{3,}"), lambda w: ~F.array_contains(stop, w))
    low = F.lower(F.coalesce(cited, F.lit("")))
    held = F.filter(said, lambda w: F.contains(low, w) | F.contains(low, F.regexp_replace(w, "s+$", "")))
    return F.when(F.size(said) > 0, F.size(held) / F.size(said))


#: Marks stripped off a token's ends; what numbers with a short unit and words look like.
_PUNCTUATION = ".,;:!?()[]{}\"'“”‘’«»…-–—/\\|*#&@^~`<>=+"
_NUMERIC = r"[\d.,:/%+\-−°×]+[A-Za-zµΩ°]{0,4}"
_WORD = r"[A-Za-z][A-Za-z'\-]*"


def let(value: Column, body) -> Column:
    """Bind ``value`` once for use in ``body``, where repeating it would evaluate it again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_quality(text: Column, code_chars: int = 12, acronym_chars: int = 6) -> Column:
    """Share of tokens that look like words with a vowel, numbers, codes or acronyms; 0 without tokens.

    Each token is stripped once, and the tokens are made once for their number and for those that are good.
    """
    pairs = F.transform(words(text), lambda w: F.struct(w.alias("raw"), F.btrim(w, F.lit(_PUNCTUATION)).alias("t")))

    def good(x: Column) -> Column:
        raw, t = x["raw"], x["t"]
        as_word = F.when(F.length(t) == 1, t.isin("a", "A", "I")).otherwise(
            t.rlike("[aeiouyAEIOUY]") | (~t.rlike("[a-z]") & (F.length(t) <= acronym_chars))
        )
        code = t.rlike("[A-Za-z]") & t.rlike("[0-9]") & (F.length(t) <= code_chars)
        sound = ~F.contains(raw, F.lit("(cid:")) & ~F.contains(t, F.lit("�"))
        return sound & F.when(t.rlike(f"^{_WORD}$"), as_word).when(t.rlike(f"^{_NUMERIC}$"), F.lit(True)).otherwise(code)

    share = lambda ts: F.when(F.size(ts) > 0, F.size(F.filter(ts, good)) / F.size(ts)).otherwise(F.lit(0.0))
    return let(F.filter(pairs, lambda x: x["t"] != ""), share)


def needs_ocr(text: Column, image_cover: Column, quality: Column | None = None, least_chars: int = 30, least_quality: float = 0.6) -> Column:
    """Why a page must be read by OCR: no_text_layer, low_text_quality, or null. image_cover: largest image's share;
    quality: the text's, where it is known already."""
    chars = F.length(F.trim(F.coalesce(text, F.lit(""))))
    scanned = (F.coalesce(image_cover, F.lit(0.0)) >= 0.5) | (chars == 0)
    return F.when(chars < least_chars, F.when(scanned, F.lit("no_text_layer"))).when(
        (text_quality(text) if quality is None else quality) < least_quality, F.lit("low_text_quality")
    )


def figure_id(caption: Column) -> Column:
    """``FIG. 2`` or ``Figure 3A`` from the beginning of a caption, else null."""
    pattern = r"(?i)^\s*(FIG(?:URE)?\.?|Figure)\s*(\d+[A-Za-z]?)"
    word, number = F.upper(F.regexp_extract(caption, pattern, 1)), F.upper(F.regexp_extract(caption, pattern, 2))
    label = F.when((word == "FIG") | word.startswith("FIG."), F.lit("FIG. ")).otherwise(F.lit("Figure "))
    return F.when(number != "", F.concat(label, number))


def table_row_text(title: Column, header: Column, cells: Column) -> Column:
    """``Table: title | column: value | ...``; empty cells are skipped, columns without a name are col<n>."""
    def cell(v: Column, i: Column) -> Column:
        name = F.coalesce(F.nullif(F.try_element_at(header, i + 1), F.lit("")), F.concat(F.lit("col"), (i + 1).cast("string")))
        return F.when(F.coalesce(v, F.lit("")) != "", F.concat(name, F.lit(": "), v))

    head = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("Table: "), title)).otherwise(F.lit("Table"))
    return F.concat_ws(" | ", F.concat(F.array(head), F.filter(F.transform(cells, cell), lambda x: x.isNotNull())))


def typed_row_text(table: str, row: Column, values: dict[str, Column], most: int = ROW_COLUMNS) -> Column:
    """``<table> row <n>: column=value; ...`` over filled columns, the first ``most`` of them."""
    pairs = F.filter(
        F.array(*(F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{k}="), v.cast("string"))) for k, v in values.items())),
        lambda x: x.isNotNull(),
    )
    rest = F.when(F.size(pairs) > most, F.format_string("; … (%d more columns)", F.lit(len(values) - most))).otherwise(F.lit(""))
    return F.concat(F.lit(f"{table} row "), row.cast("string"), F.lit(": "), F.array_join(F.slice(pairs, 1, most), "; "), rest)


def join_lines(lines: Column) -> Column:
    """Join wrapped lines by blanks; a hyphen at a line's end goes if the next begins in lower case."""
    def add(text: Column, line: Column) -> Column:
        glued = F.concat(F.substring(text, F.lit(1), F.length(text) - 1), line)
        return F.when(text.endswith("-") & line.rlike(r"^\p{Ll}"), glued).when(text != "", F.concat_ws(" ", text, line)).otherwise(line)

    return F.trim(F.regexp_replace(F.aggregate(lines, F.lit(""), add), "[ \\t]+", " "))


def join_spans(spans: Column) -> Column:
    """Join spans (x0, x1, size, text); a blank goes between those more than a quarter em apart, unless one is there."""
    start = F.struct(F.lit("").alias("out"), F.lit(None).cast("double").alias("x1"))

    def add(acc: Column, s: Column) -> Column:
        apart = (s["x0"] - acc["x1"] > 0.25 * F.greatest(s["size"], F.lit(1.0))) & ~acc["out"].endswith(" ") & ~s["text"].startswith(" ")
        joined = F.concat(acc["out"], F.when(acc["x1"].isNotNull() & apart, F.lit(" ")).otherwise(F.lit("")), s["text"])
        return F.struct(joined.alias("out"), s["x1"].cast("double").alias("x1"))

    return F.aggregate(F.filter(spans, lambda s: s["text"] != ""), start, add, lambda acc: acc["out"])


def running_key(text: Column) -> Column:
    """A line with its digits masked, so that page numbers do not tell lines apart."""
    return F.regexp_replace(F.trim(text), "\\d+", "#")


def typographic(text: Column) -> Column:
    """Plain quotes, dashes and blanks, lower case: for comparing texts."""
    plain = F.translate(text, "‘’“”–—− ", "''\"\"--- ")
    return F.trim(F.regexp_replace(F.lower(plain), r"\s+", " "))


def first_json(text: Column) -> Column:
    """The first JSON object in a text, as a variant; null if there is none."""
    return F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))


def content_hash(value: Column, length: int = 64) -> Column:
    return F.left(F.sha2(value, 256), F.lit(length))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


#: Connections and words of visible text that a figure's description keeps.
DESCRIBED = (12, 40)


def description_text(reply: Column) -> Column:
    """A figure's description from a model's reply, a JSON object: summary, labelled parts, counts, connections and
    visible text, as far as they are there, with a bar between; null if the reply holds no object. The reply is parsed
    once for all its parts."""

    def body(v: Column) -> Column:
        rows = lambda name, kind: F.coalesce(F.try_variant_get(v, f"$.{name}", kind), F.array().cast(kind))
        listed = lambda head, xs, by="; ": F.when(F.size(xs) > 0, F.concat(F.lit(head), F.array_join(xs, by)))
        named = F.filter(rows("labelled_parts", "array<struct<label string, name string>>"), lambda x: F.coalesce(x["label"], F.lit("")) != "")
        counted = rows("counts", "array<struct<count string, item string>>")
        parts = [
            F.nullif(F.try_variant_get(v, "$.summary", "string"), F.lit("")),
            listed("Parts: ", F.transform(named, lambda x: F.concat_ws(" = ", x["label"], x["name"]))),
            listed("Counts: ", F.transform(counted, lambda x: F.concat_ws(" ", x["count"], x["item"]))),
            listed("Connections: ", F.slice(rows("connections", "array<string>"), 1, DESCRIBED[0])),
            listed("Visible text: ", F.slice(rows("visible_text", "array<string>"), 1, DESCRIBED[1]), " "),
        ]
        return F.when(v.isNotNull(), F.concat_ws(" | ", *parts))

    return F.element_at(F.transform(F.array(first_json(reply)), body), 1)


def graded(reply: Column, word: Column) -> Column:
    """Whether a grader calls an answer correct: by the field of the JSON object in its reply, else by its one-word
    verdict; without either it is not."""
    told = F.try_variant_get(first_json(reply), "$.correct", "boolean")
    return F.coalesce(told, F.upper(F.trim(word)).startswith("CORRECT"), F.lit(False))
