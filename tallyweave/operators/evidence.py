"""Masking, and checking the figures a text states against the rows behind it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Columns that must not leave unmasked.
SENSITIVE = ("resource_employee", "national_id", "compensation", "customer", "customer_name", "employee",
             "employee_name", "salary", "pay_rate")


def token(value: Column) -> Column:
    return F.concat(F.lit("<masked:"), F.substring(F.sha2(value.cast("string"), 256), 1, 12), F.lit(">"))


def mask_columns(df: DataFrame, sensitive: Sequence[str] = SENSITIVE) -> DataFrame:
    """Sensitive columns as repeatable tokens, so grouping still works. NULL is masked as the text "None"."""
    named = [c for c in df.columns if c.lower() in sensitive]
    return df.withColumns({c: token(F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in named})


def mask_text(text: Column) -> Column:
    """``key = value`` fragments of sensitive keys with the value as a token; all other text is kept.

    The text is cut at the fragments and put together again, so it stays one JVM expression.
    """
    keys = "|".join(sorted(SENSITIVE, key=len, reverse=True))
    fragment = rf"(?i)\b(?:{keys})\b\s*(?:=|:|is)\s*[^,;\n]+"
    parts = rf"(?is)^((?:{keys})\s*(?:=|:|is)\s*)([^,;\n]+)$"
    between = F.split(text, fragment, -1)
    found = F.regexp_extract_all(text, F.lit(f"({fragment})"), 1)
    masked = F.transform(found, lambda m: F.concat(
        F.regexp_extract(m, parts, 1), token(F.regexp_replace(F.regexp_extract(m, parts, 2), r"^\s+|\s+$", ""))))
    return F.array_join(F.flatten(F.zip_with(between, masked, lambda b, m: F.array(b, F.coalesce(m, F.lit(""))))), "")


# -- claims ------------------------------------------------------------------------------------------

# A number with thousands separators, a decimal part and a scale, not inside a word.
NUMBER = (r"(?<![A-Za-z0-9_])(-?(?:\d{1,3}(?:,\d{3})+|\d+|\.\d+)(?:\.\d+)?)"
          r"(\s*(?:billion|million|thousand|[kKmMbB]|%))?(?![A-Za-z0-9_])")
# What each scale multiplies by, as a power of ten.
SCALES = {"k": 3, "thousand": 3, "m": 6, "million": 6, "b": 9, "billion": 9, "%": -2}
# Row keys each bridge word stands for.
LEG_KEYS = {
    "price": ("price", "price_variance"), "volume": ("volume", "volume_variance"),
    "mix": ("mix", "mix_variance", "mix_between", "mix_between_variance", "mix_within"),
    "fx": ("fx", "fx_variance"), "rate": ("rate", "rate_variance"), "efficiency": ("efficiency", "efficiency_variance"),
    "gap": ("gap", "total_gap", "change", "delta"), "residual": ("residual",),
}
# Measures whose level a text may state.
LEVEL_WORDS = ("revenue", "cost", "margin")
# Words that name a measure in a text.
LABELS = (
    ("fx", r"exchange rates?|currenc(?:y|ies)|fx|z[lł]oty|translation"),
    ("price", r"bill rates?|pric(?:e|es|ing)|discount\w*|rate erosion"),
    ("rate", r"cost rates?|rates?"),
    ("volume", r"volume"),
    ("mix", r"mix|blend|pyramid"),
    ("efficiency", r"efficiency|productivity"),
    ("residual", r"residual|unexplained"),
    ("gap", r"gap|miss(?:ed|es)?|shortfall|overall change|total change"),
    ("revenue", r"revenues?|sales"),
    ("cost", r"costs?|spend"),
    ("margin", r"margins?"),
)
# Words of direction, and the words before a stated change.
DOWN = (r"fell|fall(?:s|ing)?|dropped|drops?|declin\w*|decreas\w*|down|lower|shrank|miss(?:ed|es)?|short|lost|loss|"
        r"reduc\w*|cut|negative|below")
UP = r"rose|ris(?:e|es|ing)|grew|grow\w*|increas\w*|up|higher|gain\w*|beat|above|positive|improv\w*|added"
CHANGE = r"\b(by|of)\s*$"
# Wording that claims a filtered figure covers the whole scope.
OVERREACH = (r"(?i)alongside other entit|not (?:isolated|restricted|limited|filtered) to|full (?:result|entity|query) scope"
             r"|reflect(?:s|ing)? the full|(?:figures?|results?|numbers?|totals?|revenue|cost)[^.]{0,80}"
             r"\bfor the (?:caller'?s|your)[^.]{0,30}scope")

VALUE = "decimal(38,10)"


def numbers(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Every number a text states: its place, its size in units, its sign and the words since the one before.

    ``key`` names one text. Splitting on the same pattern gives exactly the text between two numbers; ``span`` is the
    length of that text and the number. Trailing zeros do not count. A size that has more than ten places, or 28 digits
    before the point, is not ``comparable``: no evidence value is kept that finely, so it equals none.
    """
    c = F.col
    found, value, scale = (F.regexp_extract_all(c(text), F.lit(NUMBER), F.lit(group)) for group in range(3))
    listed = texts.select(key, F.posexplode(F.arrays_zip(
        found.alias("claim"), value.alias("value"), scale.alias("scale"),
        F.slice(F.split(c(text), NUMBER, -1), F.lit(1), F.size(found)).alias("before"))).alias("place", "n"))
    rows = listed.select(
        key, "place", "n.claim", F.element_at(F.split("n.before", r"[.;:\n]", -1), -1).alias("window"),
        (F.length("n.before") + F.length("n.claim")).alias("span"), F.replace(c("n.value"), F.lit(","), F.lit("")).alias("raw"),
        F.lower(F.trim(F.regexp_replace("n.scale", r"\s", ""))).alias("scale"))
    power = F.coalesce(*[F.when(c("scale") == k, p) for k, p in SCALES.items()], F.lit(0))
    places = F.length(F.rtrim(F.regexp_extract("raw", r"\.(\d+)$", 1), F.lit("0")))
    rows = rows.withColumn("size", F.concat("raw", F.lit("E"), power.cast("string")))
    size = F.when(places - power <= 10, F.abs(F.expr(f"try_cast(size as {VALUE})")))
    return rows.withColumns({"magnitude": size, "comparable": size.isNotNull(), "negative": c("raw").startswith("-"),
                             "scaled": c("scale") != ""}).drop("size")


def evidence_values(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Evidence rows as (text key, column name, value)."""
    pairs = F.array(*[F.struct(F.lit(n.lower()).alias("name"), F.col(n).cast(VALUE).alias("value")) for n in columns])
    return rows.select(key, F.explode(pairs).alias("e")).select(key, "e.name", "e.value").filter(F.col("value").isNotNull())


def period_years(queries: DataFrame, key: str, text: str) -> DataFrame:
    """Unscaled numbers a query names; those that read as years are period references, not claims."""
    named = numbers(queries, key, text).filter(~F.col("scaled")).select(key, "magnitude").distinct()
    whole = (F.col("magnitude") == F.floor("magnitude")) & F.col("magnitude").between(1900, 2200)
    return named.withColumn("is_year", whole)


def ungrounded(claims: DataFrame, evidence: DataFrame, context: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """Claims whose size equals no value of their evidence rows.

    A number the query names is not a claim when it reads as a year, or when no measure word is near it.
    Equality is a join on (text, size), so a text with many claims never pairs them with all its rows.
    """
    sizes = evidence.select(key, F.abs("value").cast(VALUE).alias("magnitude")).distinct()
    open_claims = claims.join(sizes, [key, "magnitude"], "left_anti").join(context, [key, "magnitude"], "left")
    year = F.coalesce("is_year", F.lit(False)) & ~F.col("scaled")
    open_claims = open_claims.filter(~year).withColumn("named", F.col("is_year").isNotNull()).drop("is_year")
    # only texts with a number that the query names need their words read
    doubtful = open_claims.filter("named").select(key).distinct()
    words = readings(claims.join(doubtful, key, "left_semi"), texts.join(doubtful, key, "left_semi"), key, text)
    return open_claims.join(words.select(key, "place", "label"), [key, "place"], "left").filter(
        ~(F.col("named") & F.col("label").isNull())).drop("named", "label")


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern, those of two words first: at one place they take more."""
    out, depth = [""], 0
    for sign in pattern:
        depth += (sign == "(") - (sign == ")")
        if sign == "|" and not depth:
            out.append("")
        else:
            out[-1] += sign
    return sorted(out, key=lambda x: " " not in x)


def tokens(texts: DataFrame, key: str, text: str, words: Sequence[tuple[str, str]]) -> DataFrame:
    """(key, start, size, name): every place where one of the named patterns stands as words, overlapping ones too.

    A text is read once, whatever the number of patterns: it is cut before each such place, and the lengths of the parts
    add up to where the places are.
    """
    options = "|".join(sorted((a for _, p in words for a in _alternatives(p)), key=lambda x: " " not in x))
    ahead = rf"(?iuU)(?=(?<![A-Za-z])({options})(?![A-Za-z]))"
    found, parts = F.regexp_extract_all(text, F.lit(ahead), 1), F.split(text, ahead, -1)
    # without a match at the very start the first part belongs to none
    first = F.when(F.size(parts) > F.size(found), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
    cut = texts.select(key, F.posexplode(F.arrays_zip(parts.alias("part"), F.concat(first, found).alias("word"))).alias("n", "t"))
    before = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.select(key, "t.word", F.coalesce(F.sum(F.length("t.part")).over(before), F.lit(0)).alias("start"))
    name = F.coalesce(*[F.when(F.col("word").rlike(rf"(?iuU)^(?:{p})$"), n) for n, p in words])
    return placed.filter(F.col("word").isNotNull()).select(key, "start", F.length("word").alias("size"), name.alias("name"))


def readings(claims: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """Claims with the measure word nearest before each, the direction nearest before it, and whether a change is stated.

    Words and numbers of a text stand on one line; the nearest word before a number is the running maximum of word ends.
    One that began before the number's own window (the last number or sentence mark) does not count.
    """
    c = F.col
    upto = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = claims.withColumn("at", F.sum("span").over(upto) - F.length("claim"))
    end = (c("start") + c("size")).alias("end")
    asks = at.select(key, c("at").alias("pos"), F.lit(1).alias("kind"), F.struct(*at.columns).alias("claim"))
    labels = tokens(texts, key, text, LABELS).select(
        key, end.alias("pos"), F.lit(0).alias("kind"), F.struct(end, "size", "name", "start").alias("label"))
    ways = tokens(texts, key, text, (("down", DOWN), ("up", UP))).select(
        key, end.alias("pos"), F.lit(0).alias("kind"), F.struct(end, "name", "start").alias("way"))
    line = asks.unionByName(labels, allowMissingColumns=True).unionByName(ways, allowMissingColumns=True)
    seen = Window.partitionBy(key).orderBy("pos", "kind").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = line.withColumns({"label": F.max("label").over(seen), "way": F.max("way").over(seen)}).filter("kind = 1")
    since = c("claim.at") - F.length("claim.window")
    out = near.select("claim.*", F.when(c("label.start") >= since, c("label.name")).alias("label"),
                      F.when(c("way.start") >= since, c("way.name")).alias("direction"))
    stated = c("direction").isNotNull() & c("window").rlike("(?i)" + CHANGE)
    return out.withColumn("change", F.coalesce(stated, F.lit(False))).drop("at")


def _groups(name: Column) -> Column:
    """The claim groups a row key answers: its leg, "delta" for any leg, and the level words in it."""
    legs = [F.when(name.isin(*keys), F.array(F.lit(leg), F.lit("delta"))) for leg, keys in LEG_KEYS.items()]
    unit = name.startswith("plan_unit") | name.startswith("actual_unit")
    levels = [F.when(name.contains(w) & ~unit, F.array(F.lit(f"level:{w}"))) for w in LEVEL_WORDS]
    none = F.array().cast("array<string>")
    return F.flatten(F.array(*[F.coalesce(part, none) for part in (*legs, *levels)]))


def misattributed(claims: DataFrame, evidence: DataFrame, context: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """Grounded claims that are not the value of the measure, or the direction, their words give them."""
    c = F.col
    years = context.select(key, "magnitude", "is_year")
    sizes = evidence.select(key, F.abs("value").cast(VALUE).alias("magnitude")).distinct().withColumn("grounded", F.lit(True))
    read = readings(claims, texts, key, text).join(years, [key, "magnitude"], "left").join(sizes, [key, "magnitude"], "left")
    read = read.filter(~(F.coalesce("is_year", F.lit(False)) & ~c("scaled")) & (
        c("grounded").isNotNull() | (c("is_year").isNotNull() & c("label").isNull())))
    legs, levels = c("label").isin(*LEG_KEYS), c("label").isin(*LEVEL_WORDS)
    group = (
        F.when(legs, c("label")).when(levels & c("change"), "delta")
        .when(levels, F.concat(F.lit("level:"), c("label"))).when(c("change"), "delta")
    )
    signed = F.when(c("negative"), -c("magnitude")).when(c("direction") == "down", -c("magnitude")).when(
        c("direction") == "up", c("magnitude"))
    exact = signed.isNotNull() & (c("negative") | c("change") | F.coalesce(legs, F.lit(False)))
    read = read.withColumns({
        "group": group, "wanted": F.when(exact, signed).otherwise(c("magnitude")).cast(VALUE), "exact": exact,
        "needs_change": F.coalesce(levels & c("change"), F.lit(False))}).filter(c("group").isNotNull())
    grouped = evidence.select(key, F.explode(_groups(c("name"))).alias("group"), c("value").cast(VALUE).alias("value"))
    present = grouped.select(key, "group").distinct().withColumn("present", F.lit(True))
    held = grouped.select(key, "group", F.explode(F.array(
        F.struct(c("value").alias("wanted"), F.lit(True).alias("exact")),
        F.struct(F.abs("value").cast(VALUE).alias("wanted"), F.lit(False).alias("exact")))).alias("h"))
    held = held.select(key, "group", "h.*").distinct()
    # No row of the group: the words constrain nothing, unless a level is said to have moved.
    checked = read.join(present, [key, "group"], "left").filter(c("present").isNotNull() | c("needs_change"))
    return checked.join(held, [key, "group", "wanted", "exact"], "left_anti").select(
        key, "place", "claim", "label", "direction", "magnitude")


def overreach(answers: DataFrame, text: str, query: str) -> DataFrame:
    """Answers to filtered queries that describe the figure as the whole scope."""
    filtered = F.upper(F.col(query)).contains("WHERE")
    return answers.filter(filtered & F.col(text).rlike(OVERREACH)).withColumn("found", F.regexp_extract(text, OVERREACH, 0))
