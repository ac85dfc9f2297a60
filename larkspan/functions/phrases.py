"""Phrase expansion: variants of a phrase, and phrases that sound like it, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions.draws import integer, order_key

# Words around a phrase, spoken variants, and sounds that are mistaken for one another.
LEADING = ("hey", "okay", "ok", "yo", "hi", "hey")
TRAILING = ("please", "now", "thanks", "buddy", "friend")
CONTRACTIONS = {"hey": ("hey", "hi", "hay", "heya"), "okay": ("okay", "ok", "okee", "k"), "ok": ("ok", "okay", "okee", "k"), "alexa": ("alexa",), "siri": ("siri",), "cortana": ("cortana",)}
PREFIXES = {"hey": ("hay", "say", "pay", "way", "day", "ray", "may", "he"), "ok": ("ok", "okay", "kay", "k", "ohk", "ohcay"), "okay": ("ok", "kay", "k", "ohk"), "hi": ("hi", "hai", "hay", "high"), "yo": ("yo", "yoh")}
HOMOPHONES = {"hey": ("hay",), "hi": ("hai",), "to": ("too", "two"), "for": ("fore", "four"), "marvin": ("marven",), "assistant": ("assistant",)}
VOWELS = ("a", "e", "i", "o", "u")
CONSONANTS = {"b": ("p", "d", "g"), "p": ("b", "t", "k"), "d": ("t", "b", "g"), "t": ("d", "p", "k"), "g": ("k", "j", "d"), "k": ("g", "c", "t"), "v": ("f", "b"), "f": ("v", "ph"), "s": ("z", "c", "ss"), "z": ("s",), "m": ("n",), "n": ("m",), "l": ("r",), "r": ("l",)}
ENDINGS = ("in", "en", "an", "on", "un", "ing", "eng", "ang", "ong", "ung", "ine", "ene", "ane", "one", "une", "er", "ar", "or", "ur")
CLUSTERS = {"rv": ("rb", "rp"), "rb": ("rv", "rp"), "mp": ("mb", "np"), "nd": ("nt", "ng"), "st": ("sk", "sp"), "sk": ("st", "sp"), "sp": ("st", "sk"), "th": ("t", "z"), "sh": ("ch", "s"), "ch": ("sh", "t")}
#: Topics and a few words of each; a caller may bring longer lists.
TOPICS = {
    "kitchen": ("oven", "timer", "recipe", "kettle", "plate"),
    "office": ("desk", "meeting", "printer", "folder", "calendar"),
    "outdoor": ("garden", "trail", "river", "bench", "meadow"),
    "home": ("sofa", "window", "lamp", "carpet", "stairs"),
    "technology": ("screen", "cable", "battery", "router", "keyboard"),
    "weather": ("rain", "cloud", "sunny", "storm", "wind"),
    "emotion": ("happy", "calm", "angry", "proud", "tired"),
    "time": ("morning", "evening", "minute", "weekend", "tomorrow"),
}

Words = Callable[[Column], Column]


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def words(phrase: Column) -> Column:
    """Runs of other than white space."""
    return F.filter(F.split(phrase, r"(?U)\s+"), lambda w: w != "")


def normalised(phrase: Column) -> Column:
    return F.array_join(words(phrase), " ")


def capitalised(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substr(s, F.lit(2))))


def titled(s: Column) -> Column:
    """Capitals after anything that is no letter, which includes digits and apostrophes."""
    letters = F.split(s, "")
    state = F.struct(F.lit("").alias("out"), F.lit(False).alias("inside"))
    return F.aggregate(letters, state, lambda a, c: F.struct(F.concat(a["out"], F.when(a["inside"], F.lower(c)).otherwise(F.upper(c))).alias("out"), c.rlike(r"^\p{L}$").alias("inside")), lambda a: a["out"])


def alternating(s: Column) -> Column:
    """Upper and lower case by the character's index; other characters take an index too."""
    return F.array_join(F.transform(F.split(s, ""), lambda c, i: F.when(i % 2 == 0, F.upper(c)).otherwise(F.lower(c))), "")


def punctuation_variants(phrase: Column) -> Column:
    w = words(phrase)
    n = F.size(w)
    first = F.concat(F.element_at(w, 1), F.lit(", "), F.array_join(F.slice(w, 2, n), " "))
    second = F.concat(F.element_at(w, 1), F.lit(" "), F.try_element_at(w, F.lit(2)), F.lit(", "), F.array_join(F.slice(w, 3, n), " "))
    more = F.array(first, *[F.concat(phrase, F.lit(c)) for c in (",", ".", "!", "?")])
    longer = F.when(n >= 3, F.array(second)).otherwise(F.array().cast("array<string>"))
    return F.when(n < 2, F.array(phrase)).otherwise(F.array_distinct(F.concat(F.array(phrase), F.slice(more, 1, 1), longer, F.slice(more, 2, 4))))


def casing_variants(phrase: Column) -> Column:
    return F.array_distinct(F.array(phrase, F.lower(phrase), F.upper(phrase), titled(phrase), capitalised(phrase), alternating(phrase)))


def spacing_variants(phrase: Column) -> Column:
    w, one = words(phrase), normalised(phrase)
    spaced = F.array(F.array_join(w, "  "), F.concat(F.lit(" "), one, F.lit(" ")), F.concat(F.lit(" "), one), F.concat(one, F.lit(" ")), F.array_join(w, "\t"))
    return F.array_distinct(F.concat(F.array(phrase, one), F.when(phrase.contains(" "), spaced).otherwise(F.array(phrase))))


def affix_variants(phrase: Column) -> Column:
    """Words before, words after, and the first three of either together. The phrase's own first word isn't put before it."""
    first = F.lower(F.coalesce(F.try_element_at(words(phrase), F.lit(1)), F.lit("")))
    leading = F.filter(strings(LEADING), lambda w: w != first)
    before = F.transform(leading, lambda w: F.concat(w, F.lit(" "), phrase))
    after = F.transform(strings(TRAILING), lambda w: F.concat(phrase, F.lit(" "), w))
    both = F.flatten(F.transform(F.slice(leading, 1, 3), lambda a: F.transform(strings(TRAILING[:3]), lambda b: F.concat(a, F.lit(" "), phrase, F.lit(" "), b))))
    return F.array_distinct(F.concat(F.array(phrase), before, after, both))


def _table(pairs: dict[str, tuple[str, ...]], most: int) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), strings(v[:most]))])


def _replaced(phrase: Column, change: Words) -> Column:
    """Every phrase that results from putting one of ``change(clean word)`` in a word's place, its outer punctuation kept."""
    w = words(phrase)

    def at(word: Column, i: Column) -> Column:
        before, clean, after = (F.regexp_extract(word, r"^([^\p{L}\p{N}]*)(.*?)([^\p{L}\p{N}]*)$", k) for k in (1, 2, 3))
        low = F.lower(clean)
        own = F.filter(F.coalesce(change(low), F.array().cast("array<string>")), lambda x: x != low)
        return F.transform(own, lambda x: F.array_join(F.concat(F.slice(w, F.lit(1), i), F.array(F.concat(before, x, after)), F.slice(w, i + 2, F.size(w))), " "))

    return F.flatten(F.transform(w, at))


def contraction_variants(phrase: Column) -> Column:
    return F.array_distinct(F.concat(F.array(phrase), _replaced(phrase, lambda w: F.try_element_at(_table(CONTRACTIONS, 3), w))))


def _with(variants: Column, *changes: Words) -> Column:
    return F.flatten(F.transform(variants, lambda v: F.array(*[c(v) for c in changes])))


def all_variants(phrase: Column) -> Column:
    """The union of all families, of families with casing, and of affixes and contractions with punctuation and blanks."""
    p, s, a, c = punctuation_variants(phrase), spacing_variants(phrase), affix_variants(phrase), contraction_variants(phrase)
    rest = lambda x: F.slice(x, F.lit(2), F.size(x))
    ends = lambda *marks: [lambda v, m=m: F.concat(v, F.lit(m)) for m in marks]
    triple = F.array_join(words(phrase), "   ")
    wide = F.when(F.size(words(phrase)) >= 2, F.array(triple, F.upper(triple))).otherwise(F.array().cast("array<string>"))
    families = [
        p, casing_variants(phrase), s, a, c,
        _with(rest(p), F.upper, F.lower, titled),
        _with(rest(s), F.upper, F.lower),
        _with(a, F.upper, F.lower, titled),
        _with(rest(c), F.upper, F.lower),
        _with(c, *ends(" ", ".", "!", "?"), lambda v: F.concat(F.lit(" "), v)),
        _with(a, *ends(".", "!", "?", ",")),
        wide,
    ]
    return F.array_distinct(F.concat(*families))


def generate_variants(phrases: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """``phrase, rank, variant``: up to ``count`` variants: the phrase, upper, title, with ``!``, then others by a draw."""
    if count < 1:
        raise ValueError(f"the count must be at least 1, got {count}")
    clean = phrases.select(normalised(F.col("phrase")).alias("phrase")).where("phrase <> ''").distinct()
    first = F.array(F.col("phrase"), F.upper("phrase"), titled(F.col("phrase")), F.concat("phrase", F.lit("!")))
    every = F.array_union(F.filter(first, lambda x: F.array_contains(F.col("__all"), x)), F.array().cast("array<string>"))
    others = F.array_sort(F.transform(F.array_except("__all", "__first"), lambda v: F.struct(order_key(seed, "variant", v).alias("k"), v.alias("v"))))
    rows = clean.withColumn("__all", all_variants(F.col("phrase"))).withColumn("__first", every)
    chosen = F.slice(F.concat("__first", F.transform(others, lambda x: x["v"])), 1, count)
    return rows.select("phrase", F.posexplode(chosen).alias("rank", "variant"))


def homophones(phrase: Column) -> Column:
    return _replaced(phrase, lambda w: F.try_element_at(_table(HOMOPHONES, 3), w))


def _letters(phrase: Column, table: dict[str, tuple[str, ...]], least: int) -> Column:
    """Every substitution of one letter: all that draws could give, in place of some of them."""
    lookup = _table(table, 9)

    def change(w: Column) -> Column:
        chars = F.split(w, "")
        made = F.flatten(F.transform(chars, lambda c, i: F.transform(F.coalesce(F.try_element_at(lookup, c), F.array().cast("array<string>")), lambda x: F.concat(F.substr(w, F.lit(1), i), x, F.substr(w, i + 2)))))
        return F.when(F.length(w) >= least, made).otherwise(F.array().cast("array<string>"))

    return _replaced(phrase, change)


def vowel_substitutions(phrase: Column) -> Column:
    return _letters(phrase, {v: tuple(x for x in VOWELS if x != v) for v in VOWELS}, 2)


def consonant_substitutions(phrase: Column) -> Column:
    return _letters(phrase, CONSONANTS, 2)


def rhymes(phrase: Column) -> Column:
    """Each ending in place of as many last letters, in words of three letters or more that are longer than it by two."""

    def change(w: Column) -> Column:
        fitting = F.filter(strings(ENDINGS), lambda e: (F.length(w) > F.length(e) + 1) & (F.length(w) >= 3))
        return F.transform(fitting, lambda e: F.concat(F.substr(w, F.lit(1), F.length(w) - F.length(e)), e))

    return _replaced(phrase, change)


def prefix_substitutions(phrase: Column) -> Column:
    """For each known beginning of the first word, up to four others in the whole word's place."""
    w = words(phrase)
    first = F.lower(F.regexp_extract(F.coalesce(F.try_element_at(w, F.lit(1)), F.lit("")), r"^[^\p{L}\p{N}]*(.*?)[^\p{L}\p{N}]*$", 1))
    options = [F.when(first.startswith(k), strings(v[:4])).otherwise(F.array().cast("array<string>")) for k, v in PREFIXES.items()]
    return F.transform(F.filter(F.flatten(F.array(*options)), lambda x: x != first), lambda x: F.array_join(F.concat(F.array(x), F.slice(w, F.lit(2), F.size(w))), " "))


def cluster_substitutions(phrase: Column) -> Column:
    """The first occurrence of each cluster in each word, by up to two others."""

    def change(w: Column) -> Column:
        made = []
        for k, others in CLUSTERS.items():
            at = F.call_function("locate", F.lit(k), w)
            cut = [F.concat(F.substr(w, F.lit(1), at - 1), F.lit(o), F.substr(w, at + len(k))) for o in others[:2]]
            made.append(F.when(at > 0, F.array(*cut)).otherwise(F.array().cast("array<string>")))
        return F.flatten(F.array(*made))

    return _replaced(phrase, change)


def confusion_candidates(phrase: Column) -> Column:
    """All substitutions in lower case, without the phrase itself."""
    every = F.concat(homophones(phrase), vowel_substitutions(phrase), consonant_substitutions(phrase), rhymes(phrase), prefix_substitutions(phrase), cluster_substitutions(phrase))
    return F.array_distinct(F.filter(F.transform(every, F.lower), lambda x: (x != F.lower(phrase)) & (F.trim(x) != "")))


def contains_any(phrase: Column, wake_word: str) -> Column:
    """Whether a word of the phrase is one of the wake word's, underscores being blanks."""
    own = sorted({w for w in wake_word.replace("_", " ").lower().split()})
    return F.arrays_overlap(words(F.lower(phrase)), strings(own)) if own else F.lit(False)


def synthetic_negatives(spark: SparkSession, vocabulary: list[str], wake_word: str, count: int, least: int = 2, most: int = 4, strategy: str = "random", topic: str | None = None, topics: dict[str, tuple[str, ...]] = TOPICS, seed: int = 42, oversample: int = 4) -> DataFrame:
    """``position, phrase``: up to ``count`` different phrases without a word of the wake word.

    ``random`` draws ``least`` to ``most`` words of the vocabulary, ``sentence`` draws three, ``topic`` takes two to four
    different words of a topic (``kitchen`` for an unknown one, a drawn one for none); another strategy is
    ``random``. ``oversample`` x ``count`` phrases are tried; different means without regard to case.
    """
    if count < 0 or least < 1 or most < least:
        raise ValueError("the count must not be negative and the lengths must be at least 1 and in order")
    taken = set(wake_word.replace("_", " ").lower().split())
    free = [w for w in vocabulary if w.lower() not in taken] or list(vocabulary)
    if not free:
        raise ValueError("the vocabulary is empty")
    i = F.col("id")
    low, high = {"topic": (2, 4), "sentence": (3, 3)}.get(strategy, (least, most))
    size = F.lit(low) + integer(seed, "size", i, high - low + 1)
    if strategy == "topic":
        lists = [topics.get(topic, TOPICS["kitchen"])] if topic is not None else list(topics.values())
        own = F.element_at(F.array(*[strings(t) for t in lists]), integer(seed, "topic", i, len(lists)) + 1)
        mixed = F.array_sort(F.transform(own, lambda w: F.struct(order_key(seed, "word", F.concat_ws("-", i.cast("string"), w)).alias("k"), w.alias("w"))))
        draws = F.transform(F.slice(mixed, F.lit(1), size), lambda x: x["w"])
    else:
        # One literal, however many words there are.
        own = F.split(F.lit("\u001f".join(free)), "\u001f")
        draws = F.transform(F.sequence(F.lit(1), size), lambda k: F.element_at(own, integer(seed, "word", F.concat_ws("-", i.cast("string"), k.cast("string")), F.size(own)) + 1))
    made = spark.range(count * oversample).select(i.alias("position"), F.array_join(draws, " ").alias("phrase")).where(~contains_any(F.col("phrase"), wake_word))
    first = made.groupBy(F.lower("phrase").alias("__k")).agg(F.min_by(F.struct("position", "phrase"), "position").alias("f"))
    return first.select("f.position", "f.phrase").orderBy("position").limit(count)


def file_name(wake_word: Column, voice: Column, index: Column) -> Column:
    return F.format_string("%s_%s_%04d.wav", wake_word, voice, index)
