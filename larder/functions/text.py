"""Text functions: tokens, tag labels, embedding text, chunks and references in messages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that search drops. Forms with an apostrophe never match, since tokens end at it.
STOP_WORDS = [
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "aren't", "as", "at", "be",
    "because", "been", "before", "being", "below", "between", "both", "but", "by", "can't", "cannot", "could", "couldn't", "did",
    "didn't", "do", "does", "doesn't", "doing", "don't", "down", "during", "each", "few", "for", "from", "further", "had",
    "hadn't", "has", "hasn't", "have", "haven't", "having", "he", "he'd", "he'll", "he's", "her", "here", "here's", "hers",
    "herself", "him", "himself", "his", "how", "how's", "i", "i'd", "i'll", "i'm", "i've", "if", "in", "into", "is", "isn't",
    "it", "it's", "its", "itself", "just", "k", "let's", "me", "might", "more", "most", "mustn't", "my", "myself", "no", "nor",
    "not", "of", "off", "on", "once", "only", "or", "other", "ought", "our", "ours", "ourselves", "out", "over", "own", "same",
    "shan't", "she", "she'd", "she'll", "she's", "should", "shouldn't", "so", "some", "such", "t", "than", "that", "that's",
    "the", "their", "theirs", "them", "themselves", "then", "there", "there's", "these", "they", "they'd", "they'll", "they're",
    "they've", "this", "those", "through", "to", "too", "under", "until", "up", "very", "was", "wasn't", "we", "we'd", "we'll",
    "we're", "we've", "were", "weren't", "what", "what's", "when", "when's", "where", "where's", "which", "while", "who",
    "who's", "whom", "why", "why's", "with", "won't", "would", "wouldn't", "you", "you'd", "you'll", "you're", "you've", "your",
    "yours", "yourself", "yourselves",
]

#: The diet label of each tag.
TAG_LABELS = {
    "vegan": "vegan",
    "vegetarian": "vegetarian", "veggie": "vegetarian", "veggie-burgers": "vegetarian", "no meat": "vegetarian", "meatless": "vegetarian",
    "kosher": "kosher", "jewish-ashkenazi": "kosher", "jewish": "kosher", "hanukkah": "kosher",
    "egg-free": "egg_free", "dairy-free": "dairy_free", "salt-free": "salt_free",
    "flour-less": "flour_less", "flourless": "flour_less", "no flour": "flour_less",
    "grain-free": "grain_free", "sugar-free": "sugar_free", "sugarless": "sugar_free", "carb-free": "carb_free",
    "low-carb": "low_carb", "very-low-carbs": "low_carb", "low-cholesterol": "low_cholesterol", "low-protein": "low_protein",
    "low-calorie": "low_calorie", "low-calories": "low_calorie", "low-saturated-fat": "low_saturated_fat",
    "gluten-free": "gluten_free", "fat-free": "fat_free", "no-shell-fish": "no_shell_fish", "diabetic": "diabetic",
    "low-sodium": "low_sodium", "nut-free": "nut_free", "low-fat": "low_fat",
    "ramadan": "halal", "amish-mennonite": "amish", "non-alcoholic": "non_alcoholic",
}

#: Words of a recipe's name that say nothing in a message.
NAME_STOP_WORDS = [
    "the", "a", "an", "of", "in", "on", "for", "and", "with", "to", "from", "recipe", "one", "two", "three", "four", "five",
    "six", "seven", "eight", "nine", "ten", "about", "this", "that", "these", "those", "breakfast", "lunch", "dinner", "brunch",
    "idea", "ideas",
]

#: Ordinals in the order they are looked for.
ORDINALS = {"first": 1, "1st": 1, "second": 2, "2nd": 2, "third": 3, "3rd": 3, "fourth": 4, "4th": 4, "fifth": 5, "5th": 5, "sixth": 6, "6th": 6, "seventh": 7, "7th": 7, "eighth": 8, "8th": 8, "ninth": 9, "9th": 9, "tenth": 10, "10th": 10}


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores in any script; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def tokenize(text: Column, drop: Sequence[str] = ()) -> Column:
    """Words of two characters or more that are neither stop words nor in ``drop``."""
    out = [*STOP_WORDS, *(d.lower() for d in drop)]
    return F.filter(words(text), lambda w: (F.length(w) > 1) & ~w.isin(*out))  # a hash set after optimisation


def tag_filters(tags: Column, labels: Mapping[str, str] = TAG_LABELS) -> Column:
    """Diet labels of an array of tags, in the order first met; null gives an empty array."""
    table = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    found = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.try_element_at(table, F.lower(t)))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def clean_for_embedding(col: Column, label: str) -> Column:
    """``"label: text."`` with list marks and unusual characters dropped; null and empty give ''."""
    text = F.lower(F.translate(F.translate(col, "[]'\"", ""), "|", ","))
    text = F.regexp_replace(text, "[^a-z0-9 .,?!]", "")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, " +", " "), " ,", ","))
    return F.when(F.coalesce(col, F.lit("")) == "", "").otherwise(F.concat(F.lit(f"{label}: "), text, F.lit(".")))


def _flat(df: DataFrame, name: str, sep: str) -> Column:
    kind = dict(df.dtypes)[name]
    return F.array_join(F.transform(F.col(name), lambda x: x.cast("string")), sep) if kind.startswith("array") else F.col(name).cast("string")


def _known(df: DataFrame, cols: Sequence[str]) -> list[str]:
    known = [c for c in cols if c in df.columns]
    if not known:
        raise ValueError(f"none of the columns {list(cols)} is there")
    return known


def concat_text(df: DataFrame, cols: Sequence[str], sep: str = ", ") -> Column:
    """Lower-case text of several columns, arrays joined by ``sep``, null as ''; absent columns are skipped."""
    return F.concat_ws(" ", *(F.coalesce(F.trim(F.lower(_flat(df, c, sep))), F.lit("")) for c in _known(df, cols)))


def labelled_text(df: DataFrame, cols: Sequence[str], prefix: str = " recipe ") -> Column:
    """Each column cleaned and labelled, then joined by a space."""
    return F.concat_ws(" ", *(clean_for_embedding(_flat(df, c, ","), f"{prefix}{c}") for c in _known(df, cols)))


def metadata_text(df: DataFrame, cols: Sequence[str]) -> Column:
    """Text of several columns with arrays joined by a space, case kept."""
    return F.concat_ws(" ", *(F.coalesce(_flat(df, c, " "), F.lit("")) for c in _known(df, cols)))


def text_configurations(df: DataFrame, configs: Mapping[str, Sequence[str]]) -> DataFrame:
    """One labelled text column per configuration of columns."""
    return df.withColumns({name: labelled_text(df, cols) for name, cols in configs.items()})


def chunks(text: Column, size: int = 300, overlap: int = 64) -> Column:
    """Windows of ``size`` characters that overlap; text up to ``size`` is one chunk, '' and null none.

    A window that ends inside a word is cut back to its last space, if it has one.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    step = size - overlap
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - overlap), F.lit(step))

    def cut(i: Column) -> Column:
        raw = F.substring(text, i, F.lit(size))
        inside = (i + size <= F.length(text)) & ~F.substring(text, i + size, F.lit(1)).isin(" ", "")
        return F.when(inside & F.contains(raw, F.lit(" ")), F.regexp_extract(raw, r"(?s)^(.*) ", 1)).otherwise(raw)

    return F.when(F.length(text) > 0, F.transform(starts, cut)).otherwise(F.array().cast("array<string>"))


def json_ids(col: Column) -> Column:
    """Ids in a JSON text: of results, of results inside a result string, else every ``"id": n`` as text."""
    ids = lambda c: F.transform(F.from_json(c, "struct<results:array<struct<id:string>>>")["results"], lambda r: r["id"].try_cast("bigint"))
    inner = F.get_json_object(col, "$.result")
    by_text = F.transform(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(r'"id"\s*:\s*"?(\d+)"?'), F.lit(1)), lambda x: x.try_cast("bigint"))
    found = F.coalesce(F.when(F.size(ids(col)) > 0, ids(col)), F.when(F.size(ids(inner)) > 0, ids(inner)), by_text)
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def recipe_reference(message: Column) -> Column:
    """The position a message names: ordinals first, then ``number n``, ``recipe number n``, ``#n``, ``recipe n``."""
    text = F.lower(message)
    out = F.lit(None).cast("int")
    for pattern in (r"recipe\s+(\d+)", r"#(\d+)", r"recipe\s+number\s+(\d+)", r"number\s+(\d+)"):
        hit = F.regexp_extract(text, pattern, 1)
        out = F.when(hit != "", hit.try_cast("int")).otherwise(out)
    for word, position in reversed(ORDINALS.items()):
        out = F.when(text.rlike(rf"\b{word}\b"), F.lit(position)).otherwise(out)
    return out


def token_overlap(name: Column, message: Column) -> Column:
    """Share of a name's informative tokens, repeats counted, that a message holds; null if there are none."""
    informative = F.filter(words(name), lambda w: ~w.isin(*NAME_STOP_WORDS))
    hits = F.size(F.filter(informative, lambda w: F.array_contains(words(message), w)))
    return F.when(F.size(informative) > 0, hits / F.size(informative))


def conversation_title(text: Column, limit: int = 27) -> Column:
    """The whole words but the last of the first ``limit`` characters, then dots; text of one word has no title of its own."""
    parts = F.filter(F.split(F.substring(text, 1, limit), r"\s+"), lambda w: w != "")
    some = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " ")
    return F.when(text.isNotNull(), F.concat(F.when(F.contains(text, F.lit(" ")), some).otherwise("New Conversation"), F.lit("...")))


#: Words in a description that set a flag.
FLAG_WORDS = {
    "is_lactose": ["milk", "cheese", "butter", "cream", "yogurt"],
    "is_gluten": ["wheat", "bread", "flour", "pasta", "cereal"],
    "contains_nuts": ["nut", "almond", "peanut", "walnut", "pecan"],
    "is_vegetable": ["vegetable", "fruit", "bean", "pea", "lentil", "spinach", "carrot", "tomato"],
}
#: Words of meat in a description.
MEAT_WORDS = ["beef", "pork", "chicken", "fish", "meat", "turkey", "lamb"]


def description_flags(descrip: Column) -> dict[str, Column]:
    """0/1 flags by substrings of a description; vegetarian is the absence of meat words."""
    low = F.lower(F.coalesce(descrip, F.lit("")))
    has = lambda ws: low.rlike("|".join(ws))
    return {k: has(v).cast("int") for k, v in FLAG_WORDS.items()} | {"is_vegetarian": (~has(MEAT_WORDS)).cast("int")}
