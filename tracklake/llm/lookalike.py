"""One consistent form for texts that look the same but differ in their characters.

1. Folding, by code point: full-width and half-width letters, ligatures, letter-like numerals and presentation
   forms become plain letters; every kind of blank becomes a space; invisible characters go; accents are
   composed; hyphens of equal look become one.
2. Script-aware repair, by token (a run of letters and marks): the script of most letters is the token's
   dominant script. Only in tokens of mixed script are look-alike letters replaced by their twins of the
   dominant script (then of the token's other scripts), and only when the result is in the corpus vocabulary (tokens
   of one script).
3. What this leaves open, and nothing else, is settled per class of equal look: a class with one spelling after
   step 2 is left alone; in one with several (no clean spelling occurs in the corpus, or clean spellings of two
   scripts look the same) all take the commonest repaired spelling, ties to the smallest. ``repairs`` tells the step
   that settled each token, and ``steps`` counts them.

So two texts have the same canonical form exactly when they look the same; case, accents, missing blanks and
other punctuation are kept apart.

Cases. A null text has no form and is left out; an empty text keeps its empty form. Repeated rows of a key
count once (of different texts of one key the smallest counts). Null keys are left out. The vocabulary covers
all rows; token tables are shuffled on distinct tokens, never broadcast or collected.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.operators.skew import expand_pairs, salted_join
from tracklake.session import checkpointed

# Letters of equal look, as Latin letter and its twins by script.
TWINS = {
    "Cyrillic": {
        "a": "а", "c": "с", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "ј", "o": "о", "p": "р", "q": "ԛ", "s": "ѕ", "w": "ԝ", "x": "х", "y": "у",
        "A": "А", "B": "В", "C": "С", "E": "Е", "G": "Ԍ", "H": "Н", "I": "І", "J": "Ј", "K": "К", "M": "М", "O": "О", "P": "Р", "S": "Ѕ", "T": "Т", "W": "Ԝ", "X": "Х", "Y": "Ү",
    },
    "Greek": {
        "o": "ο", "p": "ρ", "v": "ν", "i": "ι", "u": "υ", "a": "α",
        "A": "Α", "B": "Β", "E": "Ε", "Z": "Ζ", "H": "Η", "I": "Ι", "K": "Κ", "M": "Μ", "N": "Ν", "O": "Ο", "P": "Ρ", "T": "Τ", "Y": "Υ", "X": "Χ",
    },
    "Cherokee": {"A": "Ꭺ", "C": "Ꮯ", "E": "Ꭼ", "H": "Ꮋ", "J": "Ꭻ", "K": "Ꮶ", "L": "Ꮮ", "M": "Ꮇ", "P": "Ꮲ", "R": "Ꭱ", "S": "Ꮪ", "T": "Ꭲ", "V": "Ꮩ", "W": "Ꮃ", "Z": "Ꮓ"},
    "Coptic": {"o": "ⲟ", "p": "ⲣ", "c": "ⲥ", "B": "Ⲃ", "C": "Ⲥ", "H": "Ⲏ", "I": "Ⲓ", "K": "Ⲕ", "M": "Ⲙ", "O": "Ⲟ", "P": "Ⲣ", "T": "Ⲧ", "X": "Ⲭ"},
    "Armenian": {"o": "օ", "u": "ս", "n": "ո", "h": "հ", "O": "Օ", "U": "Ս", "S": "Տ", "L": "Լ", "g": "ց", "q": "զ"},
}
# Latin letters that look like another Latin letter, and a second Cyrillic twin of Y.
SAME_SCRIPT = {"ɡ": "g", "ɑ": "a", "ı": "i"}
SECOND_TWINS = {"У": "Y"}
# Hyphens that look like the hyphen-minus.
HYPHENS = "\u2010\u2011"
# Characters without a glyph that are not of category Cf.
UNSEEN = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0" + "".join(chr(c) for c in range(0xFE00, 0xFE10))
# Kinds of compatibility decomposition that keep the look of a letter or blank.
KEPT_KINDS = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")

LATIN_OF = {twin: latin for twins in TWINS.values() for latin, twin in twins.items()} | SECOND_TWINS | SAME_SCRIPT
SCRIPT_OF_TWIN = {twin: script for script, twins in TWINS.items() for twin in twins.values()} | dict.fromkeys(SECOND_TWINS, "Cyrillic")


@lru_cache(maxsize=65_536)
def _fold(c: str) -> str:
    if c in UNSEEN or unicodedata.category(c) == "Cf":
        return ""
    if c.isspace() or unicodedata.category(c) == "Zs":
        return " "
    if c in HYPHENS:
        return "-"
    if unicodedata.decomposition(c).startswith(KEPT_KINDS):
        whole = unicodedata.normalize("NFKC", c)
        # A spacing accent would decompose to a blank and a mark: that looks different from both.
        return c if whole.startswith(" ") and len(whole) > 1 else whole
    return c


def folded(text: str) -> str:
    """Step 1."""
    if text.isascii():
        return "".join(" " if c.isspace() else c for c in text) if any(c.isspace() and c != " " for c in text) else text
    return unicodedata.normalize("NFC", "".join(map(_fold, unicodedata.normalize("NFC", text))))


@lru_cache(maxsize=65_536)
def script(c: str) -> str | None:
    """Script of a letter by its Unicode name; None for anything else."""
    if not c.isalpha():
        return None
    first = unicodedata.name(c, "").partition(" ")[0]
    return {"CJK": "Han", "HIRAGANA": "Kana", "KATAKANA": "Kana", "KATAKANA-HIRAGANA": "Kana"}.get(first, first.title())


def pieces(text: str) -> list[str]:
    """Alternating tokens (letters and marks) and what is between them; joined they give the text."""
    out: list[str] = []
    word = None
    for c in text:
        is_word = c.isalpha() or unicodedata.category(c)[0] == "M"
        if is_word is word:
            out[-1] += c
        else:
            out.append(c)
            word = is_word
    return out


def look(token: str) -> str:
    """The token with every look-alike as its Latin twin, accents kept: equal for tokens of equal look."""
    base = unicodedata.normalize("NFD", token)
    return unicodedata.normalize("NFC", "".join(LATIN_OF.get(c, c) for c in base))


def in_script(token: str, target: str) -> str:
    """The token with look-alikes of other scripts replaced by their twins of ``target``."""
    out = []
    for c in unicodedata.normalize("NFD", token):
        if script(c) == target and c not in SAME_SCRIPT:
            out.append(c)
        elif target == "Latin":
            out.append(LATIN_OF.get(c, c))
        else:
            out.append(TWINS.get(target, {}).get(LATIN_OF.get(c, c), c))
    return unicodedata.normalize("NFC", "".join(out))


def describe(token: str) -> tuple[bool, list[str], str]:
    """(of mixed script, the token in each of its scripts, its dominant one first, its look)."""
    letters = unicodedata.normalize("NFD", token)
    count = Counter(s for s in map(script, letters) if s)
    odd = any(c in SAME_SCRIPT for c in token)
    if len(count) <= 1 and not odd:
        return False, [], look(token)
    # Most letters decide; a draw goes to the script with a letter that has no look-alike, then to Latin.
    own = Counter(s for c in letters if (s := script(c)) and c not in LATIN_OF and not any(c in t for t in TWINS.values()))
    order = sorted(count, key=lambda s: (count[s], own[s], s == "Latin", s), reverse=True)
    return True, list(dict.fromkeys(in_script(token, s) for s in order)), look(token)


def folded_texts(df: DataFrame) -> DataFrame:
    """(field, text) to (field, text, pieces): the folded text in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [pieces(folded(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cut, pa.list_(pa.string()))], names=["field", "text", "pieces"])

    return df.mapInArrow(run, "field string, text string, pieces array<string>")


def described_tokens(tokens: DataFrame) -> DataFrame:
    """(token, n) to (token, n, mixed, targets, look)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [describe(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([t[0] for t in told], pa.bool_()), pa.array([t[1] for t in told], pa.list_(pa.string())), pa.array([t[2] for t in told], pa.string())],
                names=["token", "n", "mixed", "targets", "look"],
            )

    return tokens.mapInArrow(run, "token string, n long, mixed boolean, targets array<string>, look string")


def _spread(df: DataFrame) -> DataFrame:
    """Few bytes, much work in Python: one part a core of the shuffle, instead of one part in all."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def repairs(texts: DataFrame) -> DataFrame:
    """(token, fix, step): every token of ``texts`` whose consistent form differs from it, and the step that says so: ``script`` or ``class``."""
    word = F.explode("pieces").alias("token")
    counted = texts.select(word).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("token").rlike(r"\p{L}"))
    tokens = checkpointed(described_tokens(_spread(counted)))
    vocabulary = tokens.where("NOT mixed").select(F.col("token").alias("target"))
    tried = tokens.where("mixed").select("token", F.posexplode("targets").alias("place", "target")).join(vocabulary, "target")
    known = tried.groupBy("token").agg(F.min_by("target", "place").alias("known"))
    after = checkpointed(tokens.join(known, "token", "left").select("token", "n", "look", F.coalesce("known", "token").alias("form"), (~F.col("mixed") | F.col("known").isNotNull()).alias("clean")))
    # Classes with several spellings left: the commonest clean one, else the commonest.
    forms = after.groupBy("look", "form").agg(F.sum("n").alias("n"), F.max("clean").alias("clean"))
    chosen = forms.groupBy("look").agg(F.count(F.lit(1)).alias("spellings"), F.min(F.struct((~F.col("clean")).alias("a"), (-F.col("n")).alias("b"), F.col("form"))).getField("form").alias("one")).where("spellings > 1")
    fix = F.coalesce("one", "form")
    settled = after.join(chosen, "look", "left").withColumn("fix", fix).where("token <> fix")
    return settled.select("token", "fix", F.when(F.col("fix") == F.col("form"), "script").otherwise("class").alias("step"))


def steps(recs: DataFrame) -> DataFrame:
    """(step, n_tokens, n_texts): distinct tokens and texts changed by folding, by script and vocabulary, and by class."""
    texts = _cut_texts(recs)
    fixes = checkpointed(repairs(texts))
    plain = texts.where(F.array_join("pieces", "") != F.col("text")).agg(F.lit("fold").alias("step"), F.lit(None).cast("long").alias("n_tokens"), F.count(F.lit(1)).alias("n_texts"))
    words = texts.select("field", "text", F.explode(F.array_distinct("pieces")).alias("token"))
    hit = salted_join(words, fixes.select("token", "step"), ["token"], [F.col("text")]).groupBy("step", "field", "text").agg(F.lit(1).alias("one"))
    by_text = hit.groupBy("step").agg(F.count(F.lit(1)).alias("n_texts"))
    by_token = fixes.groupBy("step").agg(F.count(F.lit(1)).alias("n_tokens"))
    return plain.unionByName(by_token.join(by_text, "step").select("step", "n_tokens", "n_texts"))


def _cut_texts(recs: DataFrame) -> DataFrame:
    return checkpointed(folded_texts(_spread(recs.where("text IS NOT NULL").select("field", "text").distinct())))


def canonical_texts(records: DataFrame) -> DataFrame:
    """(field, text) of all records to (field, text, canonical), one row per distinct text of a field.

    The fields share one vocabulary.
    """
    texts = _cut_texts(records)
    fixes = checkpointed(repairs(texts).drop("step"))
    # Only tokens that can change are looked up: those outside ASCII, and ASCII ones whose look has another spelling.
    words = texts.select("field", "text", F.explode(F.array_distinct("pieces")).alias("token"))
    hits = salted_join(words, fixes, ["token"], [F.col("text")]).groupBy("field", "text").agg(F.map_from_entries(F.collect_list(F.struct("token", "fix"))).alias("fixes"))
    fixed = texts.join(hits, ["field", "text"], "left")
    return fixed.select("field", "text", F.array_join(F.when(F.col("fixes").isNull(), F.col("pieces")).otherwise(F.transform("pieces", lambda p: F.coalesce(F.element_at("fixes", p), p))), "").alias("canonical"))


def records(df: DataFrame, field: str, key: str, text: str) -> DataFrame:
    """(field, id, text): one row per key with a text."""
    return df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL").groupBy("id").agg(F.min("text").alias("text")).select(F.lit(field).alias("field"), "id", "text")


def canonical(recs: DataFrame) -> DataFrame:
    """(field, id, text, canonical) of every record."""
    return salted_join(recs, canonical_texts(recs), ["field", "text"], [F.col("id")]).select("field", "id", "text", "canonical")


def same_look_pairs(recs: DataFrame) -> DataFrame:
    """(field, id_a, id_b): records of one field whose texts look the same but are different strings, id_a < id_b.

    Links join distinct texts of one canonical form; records are expanded from them in short lists, so copies of
    one text never pair with each other and a text with a third of all rows is spread over many tasks.
    """
    recs = checkpointed(recs)
    forms = checkpointed(canonical_texts(recs))
    several = forms.groupBy("field", "canonical").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = checkpointed(forms.join(several, ["field", "canonical"]))
    a = shared.select("field", "canonical", F.col("text").alias("label_a"))
    b = shared.select("field", "canonical", F.col("text").alias("label_b"))
    links = a.join(b, ["field", "canonical"]).where("label_a < label_b").drop("canonical")
    members = salted_join(recs, shared.select("field", "text"), ["field", "text"], [F.col("id")], "left_semi")
    return expand_pairs(members.select("field", "text", "id"), links, ["field"], "text", "id")
