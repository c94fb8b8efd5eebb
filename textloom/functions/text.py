"""Scalar text functions as Column expressions. Offsets and lengths count code points; a null text gives null."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
#: Letters of a word, as the inside of a character class.
LETTERS = r"a-zA-ZáéíóúüñÁÉÍÓÚÜÑàèìòùÀÈÌÒÙâêîôûÂÊÎÔÛçÇ'\-"
#: White space of ECMAScript, as the inside of a character class (Java and RE2 read it alike).
SPACES = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: Marks that are set apart from words.
PUNCTUATION = "[.,;:!?()«»\"'\\-–—]"
NUMBER = r"^\d+([.,]\d+)*$"
GRAMMAR_TITLES = {"added": "Hitza gehitu", "removed": "Hitza kendu", "case": "Maiuskula", "other": "Gramatika"}
CAP_PUNCT_TITLES = {"case": "Maiuskula", "other": "Puntuazioa"}
SPELLING_TITLE = "Ortografia"
CONTEXT_CHARS = 28
SEGMENT_LIMIT, SEGMENT_WORDS = 25, 20


def _without_marks() -> tuple[str, str]:
    """Every character of one code point in its decomposed form without the marks U+0300 to U+036F, where that is one other
    character; then the marks, which have no counterpart."""
    found = {}
    for code in range(0xA0, 0x3000):
        c = chr(code)
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if not 0x300 <= ord(x) <= 0x36F)
        if len(bare) == 1 and bare != c:
            found[c] = bare
    return "".join(found) + "".join(map(chr, range(0x300, 0x370))), "".join(found.values())


ACCENTED, PLAIN = _without_marks()


def word_pattern(letters: str = LETTERS) -> str:
    """Words, numbers, URLs, e-mail addresses: the first that matches counts."""
    return rf"[{letters}]+|\d+(?:[.,]\d+)*|https?://\S+|[\w.-]+@[\w.-]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text: Column | str, letters: str = LETTERS) -> Column:
    """The tokens of a text, in order."""
    return F.regexp_extract_all(_c(text), F.lit(word_pattern(letters)), F.lit(0))


def is_checkable(word: Column, before: Column) -> Column:
    """Whether a token is worth a look-up; before: the token before it, null for the first. Numbers, URLs, addresses,
    single characters, words equal to their upper case, and up to five characters after a number are not."""
    skip = word.rlike(NUMBER) | word.rlike("^https?://") | F.contains(word, F.lit("@")) | (F.length(word) < 2) | (word == F.upper(word))
    return ~(skip | ((F.length(word) <= 5) & F.coalesce(before.rlike(NUMBER), F.lit(False))))


def checkable(tokens: Column | str) -> Column:
    """The tokens of an array that are worth a look-up."""
    tokens = _c(tokens)
    return F.filter(tokens, lambda w, i: is_checkable(w, F.when(i > 0, F.get(tokens, i - 1))))


def spaced_tokens(text: Column | str) -> Column:
    """Runs of white space and runs of everything else, in order; joined they are the text."""
    return F.regexp_extract_all(_c(text), F.lit(rf"([{SPACES}]+|[^{SPACES}]+)"), F.lit(1))


def plain_tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(rf"[^{SPACES}]+"), F.lit(0))


def js_trim(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), rf"^[{SPACES}]+|[{SPACES}]+$", "")


def js_trim_end(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), rf"[{SPACES}]+$", "")


def tokenize_punctuation(text: Column | str) -> Column:
    """Marks with a space on both sides, white space runs as one space, none at the ends."""
    return js_trim(F.regexp_replace(F.regexp_replace(_c(text), f"({PUNCTUATION})", " $1 "), rf"[{SPACES}]+", " "))


def detokenize_punctuation(text: Column | str) -> Column:
    """Without the white space before marks; that after them stays."""
    return F.regexp_replace(_c(text), rf"[{SPACES}]+({PUNCTUATION})", "$1")


def clean_model_output(text: Column | str) -> Column:
    """Without sentence, padding and unknown marks; white space runs of two or more as one space."""
    return js_trim(F.regexp_replace(F.regexp_replace(_c(text), "</?s>|<pad>|<unk>", ""), rf"[{SPACES}]{{2,}}", " "))


def alignment_key(token: Column | str) -> Column:
    """What two tokens are compared by: lower-cased, letters only. Tokens without letters all compare equal."""
    return F.regexp_replace(F.lower(_c(token)), "[^a-zà-ÿñü]", "")


def letters_only(text: Column | str) -> Column:
    return F.lower(F.regexp_replace(_c(text), r"[^\p{L}]", ""))


def is_case_punct_only(a: Column | str, b: Column | str) -> Column:
    """Whether two texts differ, but not in their letters regardless of case, of which there are some."""
    a, b = _c(a), _c(b)
    return (a != b) & (letters_only(a) == letters_only(b)) & (F.length(letters_only(a)) > 0)


def capitalized(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def _is_upper(ch: Column) -> Column:
    return (F.lower(ch) != ch) & (F.upper(ch) == ch)


def match_case(source: Column | str, target: Column | str) -> Column:
    """target in the case pattern of source: all capitals (two letters or more), a capital first, else lower case. A
    source without letters, or an empty one, leaves it."""
    source, target = _c(source), _c(target)
    ls = F.regexp_extract_all(source, F.lit(r"\p{L}"), F.lit(0))
    upper_count = F.size(F.filter(ls, _is_upper))
    title = F.coalesce(_is_upper(F.get(ls, F.lit(0))), F.lit(False)) & (upper_count == 1)
    return F.when((F.size(ls) == 0) | (target == ""), target).when((upper_count == F.size(ls)) & (F.size(ls) > 1), F.upper(target)).when(
        title, capitalized(F.lower(target))).otherwise(F.lower(target))


def apply_case_pattern(original: Column | str, corrected: Column | str, target: Column | str) -> Column:
    """target with a capital first if `corrected` is `original` with one; else null."""
    o, c, t = _c(original), _c(corrected), _c(target)
    a, b = F.substring(o, 1, 1), F.substring(c, 1, 1)
    ok = (F.lower(o) == F.lower(c)) & (F.length(o) > 0) & (b == F.upper(b)) & (a == F.lower(a)) & (F.lower(b) == F.lower(a))
    return F.when(ok, capitalized(t))


def word_count(text: Column | str) -> Column:
    """Parts between white space runs, empty ones included."""
    return F.size(F.split(_c(text), rf"[{SPACES}]+", -1))


def grammar_title(original: Column | str, suggestion: Column | str) -> Column:
    o, s = _c(original), _c(suggestion)
    return F.when(word_count(s) > word_count(o), GRAMMAR_TITLES["added"]).when(word_count(s) < word_count(o), GRAMMAR_TITLES["removed"]).when(
        F.lower(s) == F.lower(o), GRAMMAR_TITLES["case"]).otherwise(GRAMMAR_TITLES["other"])


def cap_punct_title(original: Column | str, suggestion: Column | str) -> Column:
    return F.when(F.lower(_c(original)) == F.lower(_c(suggestion)), CAP_PUNCT_TITLES["case"]).otherwise(CAP_PUNCT_TITLES["other"])


def title_from_h1(content: Column | str) -> Column:
    """The first line that is `# title`, without marks of emphasis, at most 50 characters; null without one."""
    found = F.regexp_extract(_c(content), r"(?m)^#\s+(.+)$", 1)
    return F.when(found != "", F.left(js_trim(F.regexp_replace(found, "[*_`#]", "")), F.lit(50)))


def word_stat(content: Column | str) -> Column:
    """Words between white space; 0 for a blank text."""
    return F.regexp_count(_c(content), F.lit(f"[^{SPACES}]+"))


def char_stat(content: Column | str) -> Column:
    return F.length(_c(content))


def escape_html(text: Column | str, apostrophe: bool = False) -> Column:
    """For element content; apostrophe: for attributes in single quotes as well."""
    out = _c(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), *((("'", "&#39;"),) if apostrophe else ())):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape_attribute(text: Column | str) -> Column:
    return F.replace(_c(text), F.lit('"'), F.lit("&quot;"))


def strip_tags(html: Column | str) -> Column:
    """The text of simple markup: comments and tags go, the five named entities are read. Script and style text stays,
    as in an element's text content. For any markup, see operators.markup.html_text."""
    out = F.regexp_replace(_c(html), r"(?s)<!--.*?-->|</?[A-Za-z!][^>]*>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def strip_accents(text: Column | str) -> Column:
    """Without accents: letters as far as U+2FFF lose their combining marks, as do marks that stand for themselves."""
    return F.translate(_c(text), ACCENTED, PLAIN)


def has_accent(text: Column | str) -> Column:
    return strip_accents(text) != _c(text)


def shortened(text: Column | str, most: int = 50) -> Column:
    """At most `most` characters, the last three of which are dots where it was longer."""
    t = _c(text)
    return F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most - 3)), F.lit("..."))).otherwise(t)


def context_before(text: Column | str, start: Column | str, most: int = CONTEXT_CHARS) -> Column:
    """Up to `most` characters of the paragraph before offset `start`, an ellipsis before them if there are more;
    without white space at the end."""
    text, start = _c(text), _c(start)
    paragraph = F.substring_index(F.substr(text, F.lit(1), start), "\n", -1)
    cut = F.length(paragraph) > most
    return js_trim_end(F.concat(F.when(cut, "…").otherwise(""), F.right(paragraph, F.lit(most))))


def masked_context(text: Column | str, start: Column | str, end: Column | str, around: int = 200, mask: str = "[MASK]") -> Column:
    """`around` characters on both sides of a span, and a mask in its place."""
    text, start, end = _c(text), _c(start), _c(end)
    low = F.greatest(F.lit(0), start - around)
    return F.concat(F.substr(text, low + 1, start - low), F.lit(mask), F.substr(text, end + 1, F.lit(around)))


def map_offset(offset: Column | str, mapping: Column | str, is_end: bool = False) -> Column:
    """Where an offset of the stripped text lies in the source; ends are exclusive, and offsets out of range are
    drawn to the nearest one."""
    o, m = _c(offset), _c(mapping)
    n = F.size(m)
    past = F.element_at(m, -1) + 1
    if is_end:
        inner = F.when(o <= 0, F.get(m, F.lit(0))).otherwise(F.get(m, o - 1) + 1)
    else:
        inner = F.get(m, F.greatest(F.lit(0), o))
    return F.when(n == 0, o).when(o >= n, past).otherwise(inner)


def segments(text: Column | str, keep_sentence_space: bool = False) -> Column:
    """array<struct<text, sep>>: sentence-like pieces for a model that reads one sentence, and what rejoins them.

    Lines are cut after . ? ! and white space; a piece of more than 25 words is cut into 20 words each. Blank lines are
    pieces without text. The pieces of one line are rejoined by a new line, on the last line by nothing, so sentences
    there run together; keep_sentence_space: rejoin sentences by a space instead, and only lines by new lines.
    """
    nothing = F.array().cast("array<struct<text:string,sep:string>>")

    def bound(x: Column, f: Callable[[Column], Column]) -> Column:
        """f(x), where x is made once, however often f names it."""
        return F.get(F.transform(F.array(x), f), F.lit(0))

    def of_line(line: Column, i: Column, n: Column) -> Column:
        end = F.when(i < n - 1, F.lit("\n")).otherwise(F.lit(""))

        def chunks(s: Column, after: Column) -> Column:
            def cut(ws: Column) -> Column:
                long = F.transform(F.sequence(F.lit(0), F.floor((F.size(ws) - 1) / SEGMENT_WORDS).cast("int")), lambda j: F.struct(
                    F.array_join(F.slice(ws, j * SEGMENT_WORDS + 1, SEGMENT_WORDS), " ").alias("text"),
                    F.when((j + 1) * SEGMENT_WORDS >= F.size(ws), after).otherwise(F.lit(" ")).alias("sep")))
                return F.when(F.size(ws) > SEGMENT_LIMIT, long).otherwise(F.array(F.struct(s.alias("text"), after.alias("sep"))))

            return bound(F.split(s, rf"[{SPACES}]+", -1), cut)

        def of_sentences(sentences: Column) -> Column:
            after = lambda k: F.when(k < F.size(sentences) - 1, F.lit(" ")).otherwise(end) if keep_sentence_space else end
            return F.coalesce(F.flatten(F.transform(sentences, lambda s, k: chunks(s, after(k)))), nothing)

        blank = F.array(F.struct(F.lit("").alias("text"), F.lit("\n").alias("sep")))
        sentences = F.filter(F.transform(F.split(line, rf"(?<=[.?!])[{SPACES}]+", -1), js_trim), lambda s: s != "")
        return F.when(~line.rlike(f"[^{SPACES}]"), blank).otherwise(bound(sentences, of_sentences))

    return bound(F.split(_c(text), "\n", -1), lambda lines: F.flatten(F.transform(lines, lambda line, i: of_line(line, i, F.size(lines)))))


def rejoined(parts: Column | str) -> Column:
    return js_trim_end(F.array_join(F.transform(_c(parts), lambda s: F.concat(s["text"], s["sep"])), ""))


def splice(text: Column | str, start: Column | str, end: Column | str, new: Column | str) -> Column:
    """text with the characters from start to end replaced."""
    text, start, end = _c(text), _c(start), _c(end)
    return F.concat(F.substr(text, F.lit(1), start), _c(new), F.substr(text, end + 1))
