"""Synthetic typos, drawn row by row.

Draws are the n-th outputs of a small counter generator whose seed is a hash of seed, document and place, so a row's
typo depends on nothing but itself: no order of rows, no state. A sentence gets one typo, in a word of four letters or
more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.edits import ALPHABET
from ..functions.planning import kept_apart
from ..functions.text import ACCENTED, capitalized, strip_accents

# Fixed values.
#: Neighbours of each letter on the keyboard.
NEIGHBOURS = {
    "q": "wa", "w": "qesa", "e": "wrds", "r": "etfd", "t": "rygf", "y": "tuhg", "u": "yijh", "i": "uokj", "o": "iplk", "p": "ol",
    "a": "qsz", "s": "awxd", "d": "sexf", "f": "drcvg", "g": "ftvbh", "h": "gybnj", "j": "hubmnk", "k": "jimol", "l": "kop",
    "z": "asx", "x": "zsdc", "c": "xvdf", "v": "cbfg", "b": "vghn", "n": "bhjm", "m": "njkl",
}
RULES = ("dropAccent", "adjTypo", "transpose", "delete", "insert", "double")
STEP = 0x6D2B79F5
MASK = 0xFFFFFFFF
WORD = r"^[A-Za-zÀ-ÿ'\-]+$"


def _multiplied(a: Column, b: Column) -> Column:
    """The low 32 bits of the product of two 32-bit numbers, halves apart, as their product overflows a long."""
    low, high = a.bitwiseAND(0xFFFF), F.shiftright(a, 16)
    return (low * b + F.shiftleft((high * b).bitwiseAND(0xFFFF), 16)).bitwiseAND(MASK)


def draw(seed: Column, n: Column | int) -> Column:
    """The n-th number (from 1) in [0, 1) of the generator `mulberry32` with a 32-bit seed."""
    n = F.lit(n) if isinstance(n, int) else n
    state = (seed.cast("long") + n.cast("long") * STEP).bitwiseAND(MASK)
    xor = lambda a, b: a.bitwiseXOR(b)
    t = _multiplied(xor(state, F.shiftrightunsigned(state, 15)), state.bitwiseOR(F.lit(1).cast("long")))
    u = xor((t + _multiplied(xor(t, F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61).cast("long")))).bitwiseAND(MASK), t)
    return xor(u, F.shiftrightunsigned(u, 14)) / F.lit(4294967296.0)


def _below(r: Column, n: Column) -> Column:
    return F.floor(r * n).cast("int")


def _replaced(w: Column, i: Column, new: Column, gone: int = 1) -> Column:
    """w with `gone` characters at place i (from 0) replaced."""
    return F.concat(F.substr(w, F.lit(1), i), new, F.substr(w, i + 1 + gone))


def apply_rule(rule: Column, word: Column, r1: Column, r2: Column) -> Column:
    """The word after a rule of RULES with two draws; the word itself where the rule does not apply."""
    n = F.length(word)
    letters = F.create_map(*(F.lit(x) for kv in NEIGHBOURS.items() for x in kv))
    places = F.filter(F.sequence(F.lit(1), n), lambda i: F.lower(F.substr(word, i, F.lit(1))).between("a", "z"))
    at = F.get(places, _below(r1, F.size(places)))
    old = F.substr(word, at, F.lit(1))
    near = F.element_at(letters, F.lower(old))
    new = F.substr(near, _below(r2, F.length(near)) + 1, F.lit(1))
    adjacent = _replaced(word, at - 1, F.when(old == F.lower(old), new).otherwise(F.upper(new)))
    i = _below(r1, n - 1)
    swapped = _replaced(word, i, F.concat(F.substr(word, i + 2, F.lit(1)), F.substr(word, i + 1, F.lit(1))), 2)
    d = _below(r1, n)
    deleted = _replaced(word, d, F.lit(""))
    extra = F.substr(F.lit(ALPHABET), _below(r2, F.lit(len(ALPHABET))) + 1, F.lit(1))
    inserted = _replaced(word, _below(r1, n + 1), extra, 0)
    doubled = _replaced(word, d, F.substr(word, d + 1, F.lit(1)), 0)
    return F.when(rule == "dropAccent", strip_accents(word)).when((rule == "adjTypo") & (F.size(places) > 0), adjacent).when((rule == "transpose") & (n >= 3), swapped).when(
        (rule == "delete") & (n > 2), deleted).when(rule == "insert", inserted).when(rule == "double", doubled).otherwise(word)


DRAWS = 10


def draws(seed: Column) -> Column:
    """The first DRAWS draws of a seed. Make them a column of their own: each is named many times by what follows, and an
    expression that holds them in place of their names grows beyond planning."""
    return F.array(*(draw(seed, n + 1) for n in range(DRAWS)))


def _one_try(word: Column, drawn: Column, k: int) -> Column:
    rule = F.element_at(F.array(*(F.lit(x) for x in RULES)), _below(F.get(drawn, F.lit(3 * k)), F.lit(len(RULES))) + 1)
    return F.struct(rule.alias("type"), F.get(drawn, F.lit(3 * k + 1)).alias("r1"), F.get(drawn, F.lit(3 * k + 2)).alias("r2"))


def with_typo(rows: DataFrame, word: str, seed: Column) -> DataFrame:
    """rows with _draws and `_t`, struct<typo, type>: the first of three tries that changes the word; null if none does,
    or if the word is shorter than three letters or holds others."""
    w = F.col(word)
    out = rows.withColumn("_draws", kept_apart(draws(seed)))
    out = out.withColumn("_tries", F.array(*(_one_try(w, F.col("_draws"), k) for k in range(3))))
    done = F.transform("_tries", lambda t: F.struct(apply_rule(t["type"], w, t["r1"], t["r2"]).alias("typo"), t["type"].alias("type")))
    out = out.withColumn("_done", kept_apart(done)).withColumn("_t", F.get(F.filter("_done", lambda t: t["typo"] != w), F.lit(0)))
    return out.withColumn("_t", F.when((F.length(w) >= 3) & w.rlike(WORD), F.col("_t"))).drop("_tries", "_done")


def generate_typos(sentences: DataFrame, key: str = "item_id", seed: int = 42) -> DataFrame:
    """key, correct, erroneous, edits (array<struct<word, typo, type, position>>) of each sentence (key, text) that has
    a word to spoil. The word is drawn among those of four letters or more; marks around it stay, as does its capital.
    """
    strip = lambda w: F.regexp_replace(w, r"[^A-Za-zÀ-ÿ'\-]", "")
    out = sentences.where("text is not null").select(F.col(key), F.col("text").alias("correct"), F.split("text", r"\s+", -1).alias("_w"))
    out = out.withColumn("_p", F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: F.length(strip(F.get(F.col("_w"), i))) >= 4)).where(F.size("_p") > 0)
    number = F.xxhash64(F.lit(seed), F.col(key), F.col("correct")).bitwiseAND(MASK)
    out = out.withColumn("_s", number).withColumn("_r", draw(F.col("_s"), 1000)).withColumn("_i", F.get("_p", _below(F.col("_r"), F.size("_p"))))
    out = out.withColumn("_raw", F.get("_w", F.col("_i"))).withColumn("_word", strip(F.col("_raw")))
    out = with_typo(out, "_word", F.col("_s")).where("_t is not null")
    first = F.substr(F.col("_word"), F.lit(1), F.lit(1))
    cased = F.when((first == F.upper(first)) & (F.lower(first) != first), capitalized(F.col("_t.typo"))).otherwise(F.col("_t.typo"))
    out = out.withColumn("_typo", cased).where("_typo != _word")
    marks = lambda pattern: F.regexp_extract(F.col("_raw"), pattern, 1)
    spoiled = F.concat(marks(r"^([^A-Za-zÀ-ÿ'\-]*)"), F.col("_typo"), marks(r"([^A-Za-zÀ-ÿ'\-]*)$"))
    out = out.withColumn("_spoiled", spoiled)
    text = F.array_join(F.transform("_w", lambda w, i: F.when(i == F.col("_i"), F.col("_spoiled")).otherwise(w)), " ")
    edit = F.struct(F.col("_word").alias("word"), F.col("_typo").alias("typo"), F.col("_t.type").alias("type"), F.col("_i").alias("position"))
    return out.select(key, "correct", text.alias("erroneous"), F.array(edit).alias("edits"))


__all__ = ["ACCENTED", "NEIGHBOURS", "RULES", "apply_rule", "draw", "draws", "generate_typos", "with_typo"]
