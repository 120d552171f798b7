"""Secret scanning: candidates by pattern, false positives removed by a random forest."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import forest
from driftline.llm.common import checkpointed, let, words

RUN = r"[A-Za-z0-9+/_\-]"
#: A long run, or a shorter one for which a key word and an assignment stand before it; the word must have a digit.
LONG, SHORT = rf"{RUN}{{16}}", rf"{RUN}{{8}}"
KEY_WORD = r"(?i)secret|token|passw|pwd|api[_\-]?key|apikey|access[_\-]?key|private[_\-]?key|credential|bearer|authori[sz]ation"
HASH_WORD = r"(?i)sha\d*|md5|commit|checksum|digest|hash|revision|etag|fingerprint|uuid|guid|serial|isbn|order|invoice|account|card|phone|ticket"
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|change.?me|your[_\-]|xxxx|test|fake|redacted|12345678|abcdef"
#: Beginnings of tokens that issuers publish (fixed values).
ISSUED = r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abpr]-|sk_live_|rk_live_|AIza|ya29|eyJ|npm_|pypi-|SG\.|dop_v1_)"
#: Parts of identifiers and plain words (fixed values).
DICTIONARY = r"(?i)the|and|ing|tion|user|name|file|path|data|list|index|image|config|version|default|string|value|model|service|client|server|update|create|report|test|main|core|utils|module|class|page|home|admin|en|er|es|de|la|le|un"

FEATURES = ["length", "digit_share", "upper_share", "transitions", "distinct_share", "dictionary_share", "hex_only", "digits_only", "uuid", "issued", "key_word", "hash_word", "placeholder", "assigned", "quoted", "path_like", "test_path"]
#: Findings the forest is trained on, and the score from which a candidate is a secret.
TRAINING, THRESHOLD = 6000, 0.5
#: What ends the text around a run: nothing before it in a word tells of the run.
BOUNDARY = r"[,;&{}?|@]|://"


def assigned(parts: list[Column]) -> Column:
    """Whether a key word in one of these words, which follow each other, has `=` or `:` after it in its word or at the start of the next."""
    found = []
    for part, following in zip(parts, [*parts[1:], F.lit("")], strict=True):
        at = F.regexp_instr(part, F.lit(KEY_WORD))
        found.append((at > 0) & (F.substr(part, F.greatest(at, F.lit(1))).rlike("[=:]") | following.rlike("^[=:]")))
    return functools.reduce(lambda a, b: a | b, found)


def candidates(df: DataFrame, id_col: str, text_col: str, path_col: str | None, keep: list[str]) -> DataFrame:
    """id, path, at (number of the word), the word and its neighbours, of each candidate in each text. Every pattern takes time linear in the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    may = text.rlike("[0-9]") & (text.rlike(LONG) | (text.rlike(SHORT) & text.rlike(KEY_WORD)))
    rows = df.select(F.col(id_col).alias("id"), path.alias("path"), text.alias("body"), *keep).where(may)

    def found(w: Column) -> Column:
        size = F.size(w)
        word = lambda i: F.when((i >= 0) & (i < size), F.get(w, i)).otherwise(F.lit(""))

        def wanted(i: Column) -> Column:
            own = F.get(w, i)
            return own.rlike("[0-9]") & own.rlike(SHORT) & (own.rlike(LONG) | assigned([word(i - 2), word(i - 1), own]))

        at = F.when(size > 0, F.filter(F.sequence(F.lit(0), size - 1), wanted)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(i.alias("at"), F.get(w, i).alias("word"), word(i - 1).alias("before"), word(i - 2).alias("before2"), word(i - 3).alias("before3"), word(i + 1).alias("after")))

    return rows.select("id", "path", *keep, F.explode(let(words(F.col("body")), found)).alias("c")).select("id", "path", *keep, "c.*")


def with_features(found: DataFrame) -> DataFrame:
    """A row for each candidate run of a word, with the run itself and the numbers in FEATURES.

    A word's main run (the last one if it ends the word, else the first; its `rank` is 0) is always a candidate; the others are
    if they have a digit and 16 characters, or 8 after an assigned key word. Where a word has
    several runs, the numbers come from the text around the run, between boundaries.
    """
    part = lambda k: F.regexp_extract_all("word", F.lit(rf"(?s)(.*?)({RUN}{{8,}}={{0,2}})"), F.lit(k))
    parts = found.select("*", part(1).alias("gaps"), part(2).alias("runs"), F.regexp_replace("word", rf"(?s)^.*{RUN}{{8,}}={{0,2}}", "").alias("rest"))
    last = F.size("runs") - 1
    parts = parts.select("*", F.when(F.col("rest").rlike("[A-Za-z0-9]"), 0).otherwise(last).alias("main"), F.regexp_replace("rest", rf"(?s)(?:{BOUNDARY}).*$", "").alias("ending"))
    get = lambda c, i: F.coalesce(F.get(c, i), F.lit(""))
    since = lambda i: F.regexp_replace(F.concat(get("gaps", i - 1), get("runs", i - 1), get("gaps", i)), rf"(?s)^.*(?:{BOUNDARY})", "")
    until = lambda i: F.when(i < last, F.regexp_replace(get("gaps", i + 1), rf"(?s)(?:{BOUNDARY}).*$", "")).otherwise(F.col("ending"))

    def wanted(i: Column) -> Column:
        run = F.get("runs", i)
        return (i == F.col("main")) | (run.rlike("[0-9]") & ((F.length(run) >= 16) | F.when(i == 0, assigned([F.col("before2"), F.col("before"), since(i)])).otherwise(assigned([since(i)]))))

    places = F.when(last > 0, F.filter(F.sequence(F.lit(0), last), wanted)).otherwise(F.array(F.lit(0)))
    places = F.transform(places, lambda i: F.struct(i.alias("i"), get("runs", i).alias("secret"), since(i).alias("since"), until(i).alias("until")))
    parts = parts.select(*found.columns, "main", (last > 0).alias("several"), F.explode(places).alias("run"))
    several, i = F.col("several"), F.col("run.i")
    first = lambda c: F.when(~several | (i == 0), F.col(c)).otherwise(F.lit("")).alias(c)
    rows = parts.select(
        *[c for c in found.columns if c not in ("word", "before", "before2", "before3")],
        *map(first, ("before", "before2", "before3")),
        F.when(several, F.concat("run.since", "run.secret", "run.until")).otherwise(F.col("word")).alias("word"),
        F.when(several, F.col("run.since")).otherwise(F.regexp_replace("word", "(?s)[=:].*$", "")).alias("lead"),
        F.col("run.secret").alias("secret"),
        F.when(several & (i != F.col("main")), i + 1).otherwise(0).alias("rank"),
    )
    rows = rows.select("*", F.concat_ws(" ", "before3", "before2", "before", "word", "after").alias("near"))
    n = F.greatest(F.length("secret"), F.lit(1)).cast("double")
    count = lambda pattern: F.regexp_count("secret", F.lit(pattern)).cast("double")
    flag = lambda condition: condition.cast("double")
    made = {
        "length": n,
        "digit_share": count("[0-9]") / n,
        "upper_share": count("[A-Z]") / n,
        "transitions": count("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])|[a-z](?=[A-Z])") / n,
        "distinct_share": F.size(F.array_distinct(F.split("secret", ""))) / n,
        "dictionary_share": 1 - F.length(F.regexp_replace("secret", DICTIONARY, "")) / n,
        "hex_only": flag(F.col("secret").rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "digits_only": flag(F.col("secret").rlike("^[0-9\\-]+$")),
        "uuid": flag(F.col("secret").rlike("(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")),
        "issued": flag(F.col("secret").rlike(ISSUED)),
        "key_word": flag(F.concat_ws(" ", "before3", "before2", "before", "lead").rlike(KEY_WORD)),
        "hash_word": flag(F.concat_ws(" ", "before3", "before2", "before", "lead").rlike(HASH_WORD)),
        "placeholder": flag(F.col("near").rlike(PLACEHOLDER)),
        "assigned": flag(F.concat_ws(" ", "before", "word").rlike("[=:]")),
        "quoted": flag(F.col("word").rlike("[\"'`]")),
        "path_like": flag(F.col("word").rlike(r"://|^/|/.*/|\.(?:com|org|net|html?|png|jpe?g|js|css|py|md|txt)\b|@")),
        "test_path": flag(F.col("path").rlike("(?i)test|example|sample|fixture|mock|docs?/")),
    }
    return rows.select("id", "path", "at", "rank", "secret", *[c for c in found.columns if c not in ("id", "path", "at", "word", "before", "before2", "before3", "after")], *[v.alias(k) for k, v in made.items()])


def labelled_findings(spark: SparkSession, n: int = TRAINING) -> DataFrame:
    """id, text, path, label: findings of known kind, made by rule from hashes of their numbers.

    Secrets (label 1) are issued tokens and random strings that a key word assigns; the others are
    commit and file hashes, UUIDs, long numbers, placeholders, identifiers, addresses and paths.
    """
    i = F.col("id")
    pick = lambda salt, options: F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64(F.lit(salt), i), F.lit(len(options))) + 1).cast("int"))
    hexes = lambda salt, k: F.substring(F.sha2(F.concat(F.lit(salt), i.cast("string")), 256), 1, k)
    mixed = lambda salt, k: F.substring(F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit(salt), i.cast("string")), 512))), "[+/=\\s]", "7"), 1, k)
    digits = lambda salt, k: F.substring(F.concat(*[F.lpad(F.conv(F.substring(hexes(salt, 60), 1 + 10 * j, 10), 16, 10), 12, "4") for j in range(3)]), 1, k)
    key = pick("key", ["token", "api_key", "secret", "password", "access_key", "auth_token", "client_secret", "API-KEY", "TOKEN", "db_password"])
    sign = pick("sign", [" = \"", "=", ": ", " : '", " = ", "= \"", " := \""])
    close = pick("close", ["\"", "", ";", "\",", "'###", "$$$"])
    word = pick("word", ["the report of", "see also", "with", "and then", "number", "el", "der", "une", "item"])
    secret = F.element_at(F.array(hexes("a", 40), hexes("b", 32), F.upper(hexes("c", 40)), mixed("d", 40), mixed("e", 24), hexes("f", 64), mixed("g", 20), mixed("h", 14)), (F.pmod(F.xxhash64(F.lit("form"), i), F.lit(8)) + 1).cast("int"))
    issued = F.concat(pick("issuer", ["ghp_", "AKIA", "sk_live_", "xoxb-", "glpat-", "AIza"]), mixed("i", 30))
    yes = F.element_at(F.array(F.concat(key, sign, secret, close), F.concat(key, sign, secret, close), F.concat(word, F.lit(" "), issued), F.concat(F.lit("Authorization: Bearer "), mixed("j", 36))), (F.pmod(F.xxhash64(F.lit("yes"), i), F.lit(4)) + 1).cast("int"))
    hashed = F.concat(pick("hash word", ["commit ", "sha1 ", "sha256: ", "md5 = ", "checksum: ", "revision ", "digest=", "etag \""]), F.element_at(F.array(hexes("k", 40), hexes("l", 32), hexes("m", 64)), (F.pmod(F.xxhash64(F.lit("hash form"), i), F.lit(3)) + 1).cast("int")))
    uuid = F.concat(word, F.lit(" "), F.concat_ws("-", hexes("n", 8), hexes("o", 4), hexes("p", 4), hexes("q", 4), hexes("r", 12)))
    number = F.concat(pick("of", ["card ", "order ", "account ", "the ", "phone: ", "los ", "invoice = "]), digits("s", 16), pick("end", ["", ".", ",", "!!", "###"]))
    placeholder = F.concat(key, sign, pick("holder", ["your_api_key_here_1234", "xxxxxxxxxxxxxxxx1234", "example-token-12345678", "changeme-changeme-1", "test_token_0123456789abcdef", "dummy0000000000000000"]), close)
    identifier = F.concat(word, F.lit(" "), pick("id", ["user_profile_image_index_2", "handleServiceUpdate2", "config_default_version_v2", "create-report-list-10", "main_module_test_03"]))
    address = F.concat(F.lit("https://"), pick("host", ["example.com/", "cdn.site.org/", "docs.host.net/"]), pick("dir", ["images/", "pages/user/", "v2/list/"]), hexes("t", 20), pick("ext", [".png", ".html", "", ".js"]))
    bare = F.concat(word, F.lit(" "), hexes("u", 40), F.lit(" "), word)
    no = F.element_at(F.array(hashed, hashed, uuid, number, number, placeholder, identifier, address, bare), (F.pmod(F.xxhash64(F.lit("no"), i), F.lit(9)) + 1).cast("int"))
    label = F.pmod(F.xxhash64(F.lit("label"), i), F.lit(2)).cast("int")
    rows = spark.range(n).select(i, label.alias("label"), yes.alias("yes"), no.alias("no"))
    path = F.when((F.col("label") == 0) & (F.pmod(F.xxhash64(F.lit("path"), i), F.lit(4)) == 0), F.lit("tests/fixtures/a.py")).otherwise(F.lit("src/app.py"))
    return rows.select("id", F.concat(word, F.lit(" "), F.when(F.col("label") == 1, F.col("yes")).otherwise(F.col("no"))).alias("text"), path.alias("path"), "label")


def train(findings: DataFrame, id_col: str = "id", text_col: str = "text", path_col: str | None = "path", label_col: str = "label", most: int = TRAINING) -> list[forest.Tree]:
    """A forest from labelled findings, `most` at most (those first by id); each text's first candidate, by its word's main run, is the finding."""
    found = with_features(candidates(findings, id_col, text_col, path_col, [label_col]))
    # one row of numbers for each of at most `most` findings
    got = found.where("rank = 0").orderBy("id", "at").limit(most).select("id", label_col, *FEATURES).toPandas().drop_duplicates("id")
    return forest.fit(got[FEATURES].to_numpy(float), got[label_col].to_numpy(int))


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", trees: list[forest.Tree] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per candidate: id, word_at, secret, the numbers in FEATURES, score, is_secret.

    A candidate is a run of 16 or more letters, digits and `+/_-` in a word with a digit, or of 8
    or more after an assigned key word; a word gives a row for each (see with_features); word_at counts words from 0. The forest, trained on the
    driver from `labelled_findings` unless given, is part of the query as conditions over the
    numbers; nothing runs outside the JVM and nothing is shuffled. Null, empty and candidate-free
    texts give no rows; rows that repeat give their findings again; a null path is empty; whole
    texts are read; other columns are ignored.
    """
    trees = trees or train(checkpointed(labelled_findings(df.sparkSession)))
    found = with_features(candidates(df, id_col, text_col, path_col, []))
    scored = found.select(F.col("id").alias(id_col), F.col("at").alias("word_at"), "secret", *FEATURES, forest.column(trees, FEATURES).alias("score"))
    return scored.select("*", (F.col("score") >= threshold).alias("is_secret"))


def redact(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with each text's secrets in `found` replaced by ***, longer ones first; ids must be unique in `df`."""
    secrets = found.where("is_secret").groupBy(id_col).agg(F.reverse(F.array_sort(F.transform(F.collect_set("secret"), lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))).alias("__secrets"))
    joined = df.join(secrets, id_col, "left")
    clean = F.aggregate(F.coalesce("__secrets", F.array().cast("array<struct<n:int,s:string>>")), F.col(text_col), lambda t, s: F.replace(t, s["s"], F.lit("***")))
    return joined.select(*[clean.alias(text_col) if c == text_col else F.col(c) for c in df.columns])
