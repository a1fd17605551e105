"""Secret scans: fixed patterns, and a battery of randomness tests under length-aware false-discovery control.

Everything here is DataFrame functions and SQL expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodica.llm.common import stored

#: The patterns of the base scan, in the order of their kinds.
PATTERNS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
}
ASSIGN_LENGTH = 12
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: The alphabets of encodings, smallest first.
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Upper ends of the length classes in which false discovery is controlled separately.
LENGTHS = (24, 32, 48, 96)


def located(text: Column, pattern: str, group: int | None = None) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, size>>: code points, end exclusive; size is the length of a group, or of the match.

    split gives what stands between matches, so lengths add up to places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), (found if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).alias("part"))
    nothing = F.expr("named_struct('at', 0, 'out', array_remove(array(named_struct('start', 0, 'end', 0, 'size', 0)), named_struct('start', 0, 'end', 0, 'size', 0)))")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"), F.length(x["part"]).alias("size")))).alias("out"))

    return F.when(F.size(found) == 0, nothing["out"]).otherwise(F.aggregate(F.filter(parts, lambda x: x["hit"].isNotNull()), nothing, step, lambda state: state["out"]))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, to about 1e-7 (Abramowitz and Stegun, 26.2.17)."""
    a = F.least(F.abs(z), F.lit(37.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * a)
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    tail = poly * F.exp(-a * a / 2) * F.lit(0.3989422804014327)
    return F.when(z >= 0, tail).otherwise(F.lit(1.0) - tail)


def encoding(token: Column) -> Column:
    """The smallest alphabet that writes the token, its padding and dashes left out; all but letters and base64 in either case."""
    bare = F.regexp_replace(token, "[=-]", "")
    return (
        F.when(bare.rlike("^[0-9]+$"), "decimal").when(bare.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(bare.rlike("^([A-Z2-7]+|[a-z2-7]+)$"), "base32").when(bare.rlike("^([A-Z0-9]+|[a-z0-9]+)$"), "base36")
        .when(bare.rlike("^[A-Za-z]+$"), "letters").otherwise("base64")
    )


def randomness(tokens: DataFrame) -> DataFrame:
    """tokens has a column token; adds encoding, n (its symbols), p_chi, p_runs, p_serial and p.

    p_chi: chi-squared test of a uniform alphabet (Wilson-Hilferty tail). p_runs: runs above and below the alphabet's
    middle, two-sided. p_serial: serial correlation of neighbours, two-sided. p: three times the least, at most 1.
    A token of equal symbols has p_serial 0; one wholly on one side of the middle has p_runs from its chance, 2**(1-n).
    """
    code = F.col("encoding")
    clean = F.when(code == "hex", F.lower(F.regexp_replace("token", "[=-]", ""))).when(code.isin("base32", "base36"), F.upper(F.regexp_replace("token", "[=-]", ""))).when(code == "base64", F.translate(F.regexp_replace("token", "=", ""), "-_", "+/")).otherwise(F.regexp_replace("token", "[=-]", ""))
    alphabet = F.coalesce(*[F.when(code == k, F.lit(a)) for k, a in ALPHABETS.items()])
    out = tokens.withColumn("encoding", encoding(F.col("token"))).withColumn("alphabet", alphabet).withColumn("clean", clean)
    out = out.withColumn("values", F.transform(F.filter(F.split("clean", ""), lambda c: c != ""), lambda c: (F.instr("alphabet", c) - 1).cast("double")))
    out = out.withColumn("n", F.size("values").cast("double")).where("n > 1").withColumn("k", F.length("alphabet").cast("double"))
    add = lambda values, f: F.aggregate(values, F.lit(0.0), lambda a, x: a + f(x))
    squares = add(F.expr("transform(sequence(0, cast(k as int) - 1), v -> cast(v as double))"), lambda v: F.pow(F.size(F.filter("values", lambda x: x == v)).cast("double"), F.lit(2.0)))
    out = out.withColumn("chi", F.col("k") / F.col("n") * squares - F.col("n")).withColumn("mean", add(F.col("values"), lambda x: x) / F.col("n"))
    pairs = F.arrays_zip(F.expr("slice(values, 1, size(values) - 1)").alias("x"), F.expr("slice(values, 2, size(values) - 1)").alias("y"))
    middle = (F.col("k") - 1) / 2
    out = out.withColumn("pairs", pairs).withColumn("high", F.size(F.filter("values", lambda x: x > middle)).cast("double"))
    out = out.withColumn("low", F.col("n") - F.col("high")).withColumn("runs", 1.0 + F.size(F.filter("pairs", lambda p: (p["x"] > middle) != (p["y"] > middle))))
    out = out.withColumn("spread", add(F.col("values"), lambda x: (x - F.col("mean")) * (x - F.col("mean")))).withColumn("serial", add(F.col("pairs"), lambda p: (p["x"] - F.col("mean")) * (p["y"] - F.col("mean"))))
    df = F.col("k") - 1
    z_chi = (F.cbrt(F.col("chi") / df) - (1 - F.lit(2.0) / (9 * df))) / F.sqrt(F.lit(2.0) / (9 * df))
    product = 2.0 * F.col("high") * F.col("low")
    variance = product * (product - F.col("n")) / (F.col("n") * F.col("n") * (F.col("n") - 1))
    one_side = (F.col("high") == 0) | (F.col("low") == 0)
    p_runs = F.when(one_side, F.pow(F.lit(2.0), 1 - F.col("n"))).when(variance <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * upper_tail(F.abs(F.col("runs") - product / F.col("n") - 1) / F.sqrt(F.greatest(variance, F.lit(1e-12))))))
    p_serial = F.when(F.col("spread") <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), 2 * upper_tail(F.abs(F.col("serial") / F.greatest(F.col("spread"), F.lit(1e-12))) * F.sqrt("n"))))
    out = out.withColumn("p_chi", F.least(F.lit(1.0), upper_tail(z_chi))).withColumn("p_runs", p_runs).withColumn("p_serial", p_serial)
    out = out.withColumn("p", F.least(F.lit(1.0), 3 * F.least("p_chi", "p_runs", "p_serial")))
    return out.drop("alphabet", "clean", "values", "k", "chi", "mean", "pairs", "high", "low", "runs", "spread", "serial")


def length_class(n: Column) -> Column:
    out = F.lit(len(LENGTHS))
    for i, top in reversed(list(enumerate(LENGTHS))):
        out = F.when(n <= top, i).otherwise(out)
    return out


def thresholds(tested: DataFrame, level: float) -> DataFrame:
    """Benjamini-Hochberg within each encoding and length class: p at most the threshold is found not to be random.

    p is counted in 2,000 steps of its logarithm, so the ranking is over at most 6 x 5 x 2,001 rows whatever the input;
    rounding up to a step can only keep more tokens.
    """
    counted = tested.groupBy("encoding", "class", "step").count()
    stratum = Window.partitionBy("encoding", "class")
    ranked = counted.withColumn("rank", F.sum("count").over(stratum.orderBy(F.desc("step")))).withColumn("all", F.sum("count").over(stratum))
    met = F.pow(F.lit(10.0), -F.col("step") / 50.0) <= F.lit(level) * F.col("rank") / F.col("all")
    return ranked.where(met).groupBy("encoding", "class").agg(F.min("step").alias("from_step"))


def scan(docs: DataFrame, level: float = 0.05) -> DataFrame:
    """Spans of secrets in every whole text of docs (doc_id, text), in code points, end exclusive.

    Base kinds are assign, access and hex. The battery adds kind random: runs of 20 or more letters, digits and +/_=-
    of at least two of lower case, upper case and digits, for which no test of uniformity, runs or serial correlation
    in their inferred encoding finds, at the given false-discovery rate within their length class, that they are not
    random. Runs that overlap a base span are not tested.

    Null text is empty; empty text has no spans. Null and repeated doc_ids keep a row each; extra columns are ignored.
    Returns doc_id, text_hash (xxhash64 of the text), n_assign, n_access, n_hex, n_random, base (array of kind, start, end), found (the same with random).
    """
    text = F.coalesce("text", F.lit(""))
    one = docs.select("doc_id", text.alias("text"))
    one = one.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), located(F.col("text"), PATTERNS["assign"], 2).alias("assign"), located(F.col("text"), PATTERNS["access"]).alias("access"), located(F.col("text"), PATTERNS["hex"]).alias("hex"), located(F.col("text"), CANDIDATE).alias("maybe"))
    long_enough = {"assign": lambda x: x["size"] >= ASSIGN_LENGTH}
    ordered = lambda i: lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("order"), x["end"].alias("end"))
    base = F.concat(*[F.transform(F.filter(k, long_enough.get(k, lambda x: F.lit(True))), ordered(i)) for i, k in enumerate(PATTERNS)])
    one = one.withColumn("base", F.array_sort(base))
    token = lambda x: F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"])
    mixed = lambda t: (t.rlike("[a-z]").cast("int") + t.rlike("[A-Z]").cast("int") + t.rlike("[0-9]").cast("int")) >= 2
    free = F.filter("maybe", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    free = F.filter(F.transform(free, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), token(x).alias("token"))), lambda x: mixed(x["token"]))
    kept = stored(one.select("doc_id", "text_hash", "base", free.alias("free")), "secret-spans")
    step = F.least(F.lit(2000), F.floor(-F.log10(F.greatest("p", F.lit(1e-40))) * 50)).cast("int")
    tested = randomness(kept.select(F.explode("free.token").alias("token")).distinct()).select("token", "encoding", length_class(F.col("n")).alias("class"), step.alias("step"))
    tested = stored(tested, "secret-tokens")  # else the filter below would take the whole battery into each of its terms
    limits = {(r[0], r[1]): r[2] for r in thresholds(tested, level).collect()}  # at most 30 rows
    rejected = F.lit(False)
    for (code, size), step in limits.items():
        rejected = rejected | ((F.col("encoding") == code) & (F.col("class") == size) & (F.col("step") >= step))
    passed = tested.where(~rejected).select("token")
    numbered = kept.withColumn("row", F.monotonically_increasing_id())
    extra = numbered.where(F.size("free") > 0).select("row", F.explode("free").alias("x")).select("row", "x.*").join(passed, "token", "left_semi")
    extra = extra.groupBy("row").agg(F.collect_list(F.struct("start", F.lit(len(PATTERNS)).alias("order"), "end")).alias("random"))
    out = numbered.join(extra, "row", "left")
    kinds = F.array(*[F.lit(k) for k in [*PATTERNS, "random"]])
    named = lambda spans: F.transform(spans, lambda x: F.struct(kinds[x["order"]].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    count = lambda i: F.size(F.filter("base", lambda x: x["order"] == i)).cast("long")
    everything = F.array_sort(F.concat("base", F.coalesce("random", F.expr("slice(base, 1, 0)"))))
    return out.select("doc_id", "text_hash", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.coalesce(F.size("random"), F.lit(0)).cast("long").alias("n_random"), named(F.col("base")).alias("base"), named(everything).alias("found"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", level: float = 0.05) -> DataFrame:
    """docs with every found span in text replaced by mark (overlapping spans by one); null texts, and all else, stay as they are."""
    found = scan(docs, level).where(F.size("found") > 0).dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("found_id"), "text_hash", F.col("found").alias("secrets_found"))
    joined = docs.join(found, docs["doc_id"].eqNullSafe(F.col("found_id")) & (F.xxhash64(docs["text"]) == F.col("text_hash")), "left")

    def step(state: Column, x: Column) -> Column:
        gap = F.when(x["start"] >= state["at"], F.concat(F.substring(docs["text"], state["at"] + 1, x["start"] - state["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.concat(state["out"], gap).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("secrets_found", begin, step, lambda s: F.concat(s["out"], F.substring(docs["text"], s["at"] + 1, F.length(docs["text"]))))
    return joined.select(*[F.when(F.col("secrets_found").isNull(), docs["text"]).otherwise(clean).alias("text") if c == "text" else docs[c] for c in docs.columns])
