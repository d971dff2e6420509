"""Secret scan: candidates by pattern, false positives removed by a random forest. Native throughout:
everything from the text to the verdict is a Column expression.

A candidate is a stretch of 16 characters or more of the alphabets that keys are written in, with a
digit, what is assigned to a name such as ``password``, or the password of a URL. The forest judges it by length, character
classes, how likely its character transitions are in the words of the corpus, the share of it that the
corpus's frequent words cover, its path and the words before and after it. It is trained on labelled
findings, in the driver, and is applied as a walk over arrays. The language statistics are counted over
all documents: words are counted where they stand, and two-letter transitions follow from the counts.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import trees
from tideline.llm.common import table
from tideline.plans.shared import Scratch

_BODY = "A-Za-z0-9_+/\\-"
#: What may stand between a telling name and its value, quote included; names in any case.
_NAME = r"(?i:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?)[\"'`]?\s{0,3}[=:]\s{0,3}"
#: The password of a URL, the value given to a telling name (up to the quote, if it is quoted), or a long
#: run with a digit. The short look-behinds in front spare most places the long ones.
PATTERN = (
    r"(?<=:)(?<=://[^\s:/@\"']{0,64}:)[^\s/@\"']{4,}(?=@)"
    rf"|(?<=[=:]\s{{0,3}}[\"'`])(?<={_NAME}[\"'`])[^\s\"'`]{{8,}}"
    rf"|(?<=[=:]\s{{0,3}})(?<={_NAME})[^\s\"'`,;]{{8,}}"
    rf"|(?<![{_BODY}])(?=[A-Za-z_+/\-]*[0-9])[{_BODY}]{{16,}}={{0,2}}"
)
CONTEXT = 48
_TELLING = r"(?i)(passw(or)?d|passphrase|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credentials?|private([_-]?key)?|pwd|://[^\s:/@]*)[^a-z0-9]*$"
_INNOCENT = r"(?i)(commit|sha(1|256)?|md5|checksum|hash|digest|revision|uuid|guid|etag|version|order|card|phone|invoice|isbn|account|id|ref)[^a-z0-9]*$"
_SAMPLE_PATH = r"(?i)(^|[/_.\-])(tests?|examples?|samples?|mocks?|fixtures?|docs?|spec)([/_.\-]|$)"
_PREFIX = r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[baprs]-|sk_live_|sk-|rk_live_|AIza|eyJ|SG\.|npm_|pypi-)"
_PLACEHOLDER = r"(?i)(example|placeholder|changeme|your|dummy|sample|xxxx|test|redacted|0{6}|1234567|abcdef)"
_UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: Frequent words of the corpus that coverage is measured with, and their least length.
DICTIONARY, LEAST_WORD = 1000, 4
#: Parts of a text whose lengths are added up at once, to find the places of candidates.
_BLOCK = 256
_MARK, _INSTEAD = "\ue000", "\ue001"

FEATURES = ("f_length", "f_digits", "f_upper", "f_lower", "f_other", "f_turns", "f_distinct", "f_hex", "f_transitions", "f_words", "f_slashes", "f_prefix", "f_uuid", "f_placeholder", "f_telling", "f_innocent", "f_assigned", "f_quoted", "f_sample_path", "f_after")


@dataclass(frozen=True)
class Language:
    """What the words of a corpus look like: its most frequent ones, longest first, and the log probability
    of each letter (or the end, 0) after each other (or the start). Both are of bounded size."""

    words: tuple[str, ...]
    transitions: tuple[float, ...]

    def likelihood(self, found: Column) -> Column:
        """The mean log probability of the transitions within the candidate, whatever isn't a letter being a
        word's end; -10 for one without letters."""
        letters = F.transform(F.split(found, ""), lambda c: F.when(F.ascii(c).between(97, 122), F.ascii(c) - 96).otherwise(0))
        steps = F.zip_with(F.concat(F.array(F.lit(0)), letters), F.concat(letters, F.array(F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        steps = F.filter(steps, lambda s: (s["a"] > 0) | (s["b"] > 0))
        table_ = F.array(*(F.lit(v) for v in self.transitions))
        return F.when(F.size(steps) > 0, F.aggregate(steps, F.lit(0.0), lambda t, s: t + F.element_at(table_, s["a"] * 27 + s["b"] + 1)) / F.size(steps)).otherwise(-10.0)

    def covered(self, found: Column) -> Column:
        """Characters of the candidate that words cover, longer words first."""
        if not self.words:
            return F.lit(0)
        left = F.aggregate(F.array(*(F.lit(w) for w in self.words)), found, lambda t, w: F.replace(t, w, F.lit(" ")))
        # each word has left one space, and candidates hold none
        return F.length(found) - F.length(F.replace(left, F.lit(" "), F.lit("")))


def learn_language(texts: DataFrame, text_col: str = "text") -> Language:
    """From every word (a run of the letters a to z, in any case) of every text. Words are counted by value,
    pre-aggregated where they stand, so a very frequent one is a row a task."""
    words = texts.select(F.explode(F.split(F.lower(F.col(text_col)), "[^a-z]+")).alias("w")).where("w <> ''").groupBy("w").count()
    scratch = Scratch(texts.sparkSession, "words")
    words = scratch.keep(words, "counts")
    end, letters = F.array(F.lit("`")), F.split("w", "")
    pairs = words.select(F.explode(F.zip_with(F.concat(end, letters), F.concat(letters, end), lambda a, b: F.concat(a, b))).alias("p"), "count")
    frequent = words.where(F.length("w") >= LEAST_WORD).orderBy(F.desc("count"), "w").limit(DICTIONARY)
    # both results are of bounded size: 27 * 27 pairs, and DICTIONARY words
    counts = [[0.5] * 27 for _ in range(27)]
    for r in pairs.groupBy("p").agg(F.sum("count").alias("n")).collect():
        counts[ord(r.p[0]) - 96][ord(r.p[1]) - 96] += r.n
    found = tuple(sorted((r.w for r in frequent.collect()), key=lambda w: (-len(w), w)))
    scratch.drop_but()
    return Language(found, tuple(math.log(n / sum(row)) for row in counts for n in row))


def features(found: Column, before: Column, after: Column, path: Column, language: Language) -> list[Column]:
    """Of a candidate, up to CONTEXT characters before and after it, and the path of its document."""
    n = F.greatest(F.length(found), F.lit(1))
    count = lambda pattern: F.regexp_count(found, F.lit(pattern))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    lower = F.lower(found)
    parts = (
        n,
        count("[0-9]") / n,
        count("[A-Z]") / n,
        count("[a-z]") / n,
        count("[^A-Za-z0-9]") / n,
        count("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]") / n,
        F.size(F.array_distinct(F.split(found, ""))) / n,
        flag(found.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        language.likelihood(lower),
        language.covered(lower) / n,
        count("[/]") / n,
        flag(found.rlike(_PREFIX)),
        flag(found.rlike(_UUID)),
        flag(found.rlike(_PLACEHOLDER)),
        flag(before.rlike(_TELLING)),
        flag(before.rlike(_INNOCENT)),
        flag(before.rlike(r"[=:]\s*[\"'`]?$")),
        flag(before.rlike(r"[\"'`]$")),
        flag(F.coalesce(path, F.lit("")).rlike(_SAMPLE_PATH)),
        flag(after.rlike(r"^[\"'`]")),
    )
    return [c.cast("double").alias(f) for c, f in zip(parts, FEATURES, strict=True)]


def labelled_findings(n: int = 3000, seed: int = 17, words: tuple[str, ...] = ()) -> list[tuple[str, str, str, str, int]]:
    """(candidate, before, after, path, label), made by rule: 1 for secrets. With ``words`` half the prose,
    and half of what is no secret, is of them."""
    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    low, high, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexa, b64 = "0123456789abcdef", low + high + num + "+/"
    word = lambda a, b: r.choice(words) if words and r.random() < 0.5 else pick(low, r.randint(a, b))
    prose = lambda: " ".join(word(2, 9) for _ in range(r.randint(1, 5)))
    assign = lambda names: prose() + " " + r.choice(names) + r.choice(["=", " = ", ": ", ":", '="', ' = "', ": '"])
    telling = ["password", "passwd", "secret", "token", "TOKEN", "api_key", "API_KEY", "apikey", "access_key", "auth_token", "client_secret", "private_key", "PASSWORD", "Password", "\"password", "db_pwd"]
    innocent = ["commit", "sha256", "md5", "checksum", "uuid", "id", "order", "version", "etag", "digest", "card", "ref", "account"]
    path = lambda: r.choice(["src/app.py", "config/prod.yml", "src3", "deploy/env", "notes", "main.go", "src0"])
    tests = ["tests/data.py", "docs/example.md", "sample/config", "fixtures/a.json"]
    strong = [lambda: pick(hexa, r.choice([18, 24, 32, 40, 64])), lambda: pick(hexa, r.choice([32, 40])).upper(), lambda: pick(b64, r.randint(20, 64)), lambda: "AKIA" + pick(high + num, 16), lambda: "ghp_" + pick(low + high + num, 36), lambda: "sk_live_" + pick(low + high + num, 24), lambda: "xoxb-" + pick(num, 11) + "-" + pick(low + high + num, 24), lambda: "eyJ" + pick(b64, 60), lambda: pick(low + high + num, r.randint(16, 40))]
    some = lambda: "".join(r.sample(pick(low, r.randint(6, 9)) + pick(high, r.randint(1, 3)) + pick(num, r.randint(1, 4)) + pick("!&#$%*?.", r.randint(0, 2)), 8))
    human = [some, lambda: pick(low, r.randint(4, 9)) + pick(num, r.randint(1, 4)) + pick(low + "!&", r.randint(3, 6)), lambda: pick(high, 1) + pick(low, 2) + pick(num, 2) + pick(low, 3) + pick("&!$", 1) + pick(num, 1), lambda: pick(low + high + num, 12)]
    plain = [lambda: pick(low, r.randint(8, 14)), lambda: word(8, 12) + word(4, 8), lambda: pick(low, 5) + "." + pick(low, 7), lambda: pick(low, 6) + "()" + pick(".,)", 1), lambda: "${" + pick(high, 8) + "}", lambda: "<" + pick(low, 9) + ">"]
    weak = [
        lambda: (r.choice(plain)(), assign(telling)),
        lambda: (pick(num, r.choice([16, 16, 17, 19, 20])), prose() + " "),
        lambda: (pick(hexa, r.choice([32, 40, 64])), assign(innocent[:5])),
        lambda: (pick(hexa, r.choice([32, 40, 64])), prose() + " commit "),
        lambda: ("-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), assign(innocent)),
        lambda: ("_".join(word(3, 8) for _ in range(3)) + pick(num, r.randint(1, 3)), prose() + " "),
        lambda: ("/".join(["usr", "static", pick(low, 6), pick(low, 9) + pick(num, 2)]), prose() + r.choice([" ", " src=\""])),
        lambda: ("-".join([word(5, 5), word(7, 7), pick(num, 4), pick(num, 2)]), prose() + " "),
        lambda: (word(5, 9) + word(5, 9) + word(4, 8) + pick(num, r.randint(1, 3)), prose() + " "),
        lambda: (r.choice(["your-api-key-here1", "xxxxxxxxxxxxxxxx1234", "changeme1234567890", "example_token_123456", "dummy-secret-00000000"]), assign(telling)),
        lambda: (pick(num, 16), assign(["card", "account", "order", "phone"])),
        lambda: ("2024-0" + pick("123456789", 1) + "-1" + pick(num, 1) + "T10-00-00", assign(["date", "time"])),
        lambda: (pick(low, 9) + pick(high, 1) + pick(low, 8) + pick(num, 1), prose() + " "),
        lambda: (pick(low, r.randint(14, 22)).replace("q", "e") + pick(num, 2), prose() + " "),
    ]
    out = []
    for _ in range(n):
        quote = r.choice(['"', "'", "", " ", "\n"])
        if r.random() < 0.5:
            if r.random() < 0.3:
                before, after = (assign(telling), quote) if r.random() < 0.8 else (prose() + " " + r.choice(["postgres", "https", "mysql", "redis"]) + "://" + pick(low, r.randint(1, 8)) + ":", "@" + pick(low, 5) + "/")
                out.append((r.choice(human)(), before[-CONTEXT:], after + prose(), path(), 1))
                continue
            found, before = r.choice(strong)(), assign(telling) if r.random() < 0.85 else prose() + " "
            if before.endswith(" ") and not found.startswith(("AKIA", "ghp_", "sk_live_", "xoxb-", "eyJ")) and not before.rstrip().endswith(("=", ":")):
                before = assign(telling)
            out.append((found, before[-CONTEXT:], quote + prose(), path(), 1))
        else:
            if r.random() < 0.08:
                out.append((r.choice(strong)(), assign(telling)[-CONTEXT:], quote, r.choice(tests), 0))
                continue
            found, before = r.choice(weak)()
            out.append((found, before[-CONTEXT:], quote + prose(), path(), 0))
    return out


@dataclass(frozen=True)
class SecretModel:
    forest: trees.Forest
    language: Language


def train(labelled: DataFrame, language: Language, *, trees_: int = 20, depth: int = 6, sample_rows: int = 20_000) -> SecretModel:
    """From (found, before, after, path, label) rows; at most about ``sample_rows`` of them, by hash."""
    n = labelled.count()
    share = int(min(1.0, sample_rows / max(n, 1)) * (1 << 30)) + 1
    rows = labelled.where("found IS NOT NULL AND label IS NOT NULL").where(F.pmod(F.xxhash64("found", "before"), F.lit(1 << 30)) < share)
    got = rows.select("label", *features(F.col("found"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")), F.col("path"), language)).collect()
    got.sort(key=tuple)
    x = np.array([[r[f] for f in FEATURES] for r in got], float).reshape(len(got), len(FEATURES))
    y = np.array([r.label for r in got], float)
    return SecretModel(trees.forest(x, y, trees_, depth) if len(got) else trees.Forest((trees.Leaf(0.0),)), language)


def default_model(texts: DataFrame, text_col: str = "text") -> SecretModel:
    """The language of these texts and a forest from the labelled findings of this module, half of whose prose
    is of that language's own frequent words."""
    language = learn_language(texts, text_col)
    rows = labelled_findings(words=language.words)
    return train(texts.sparkSession.createDataFrame(rows, "found string, before string, after string, path string, label int"), language)


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """doc_id, path, start (code points before it), found, before and after, a row for each candidate.

    One pass of the pattern marks the candidates in a copy of the text, which is then cut at the marks: what
    stands before the first candidate, the candidate, what stands behind it, and so on. A mark that the text
    holds itself is taken for another character. A candidate has four characters at least, so what stands
    around it is in the 24 parts next to it.
    """
    path = F.col(f"`{path_col}`").cast("string") if path_col else F.lit(None).cast("string")
    text = F.col(f"`{text_col}`")
    marked = F.regexp_replace(F.translate(text, _MARK, _INSTEAD), F.lit(PATTERN), F.lit(f"{_MARK}$0{_MARK}"))
    parts = F.split(marked, _MARK, -1)
    near = 2 * CONTEXT // 4
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), path.alias("path"), parts.alias("parts")).where("size(parts) > 1")
    sizes = F.transform("parts", lambda p: F.length(p))
    heads, tails = F.transform("parts", lambda p: F.substring(p, 1, CONTEXT)), F.transform("parts", lambda p: F.substring(p, -CONTEXT, CONTEXT))
    base = base.select("doc_id", "path", "parts", sizes.alias("sizes"), heads.alias("heads"), tails.alias("tails"))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    # lengths before each block of parts, so that a place is one of these and a short sum
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("sizes") - 1) / _BLOCK).cast("int")), lambda b: total(F.slice(F.col("sizes"), b * _BLOCK + 1, F.lit(_BLOCK))))
    base = base.withColumn("blocks", F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda a, x: F.array_append(a, F.element_at(a, -1) + x)))
    def found(k: Column) -> Column:
        part = k * 2
        block = F.floor((part - 1) / _BLOCK).cast("int")
        first = F.greatest(part - near, F.lit(1))
        start = F.element_at("blocks", block + 1) + total(F.slice(F.col("sizes"), block * _BLOCK + 1, part - 1 - block * _BLOCK))
        before = F.substring(F.array_join(F.slice(F.col("tails"), first, part - first), ""), -CONTEXT, CONTEXT)
        after = F.substring(F.array_join(F.slice(F.col("heads"), part + 1, F.lit(near)), ""), 1, CONTEXT)
        return F.struct(start.alias("start"), F.element_at("parts", part).alias("found"), before.alias("before"), after.alias("after"))

    hits = F.transform(F.sequence(F.lit(1), F.floor(F.size("parts") / 2).cast("int")), found)
    return base.select("doc_id", "path", F.explode(hits).alias("f")).select("doc_id", "path", "f.*")


def scan(docs: DataFrame, model: SecretModel | None = None, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """doc_id, start, length, found, sha256 (of the candidate), score and is_secret of every candidate.

    ``start`` counts the code points before the candidate; the whole text is scanned, in time in proportion
    to its length and candidates. A null or empty text has no candidates; a null path is an empty one;
    repeated rows give their candidates once each, as does a secret that repeats in a text; an empty table
    gives no rows; other columns are not read. Without a model one is made with the language of ``docs``.
    """
    model = model or default_model(docs, text_col)
    rows = candidates(docs, id_col=id_col, text_col=text_col, path_col=path_col)
    scored = rows.select("*", *features(F.col("found"), F.col("before"), F.col("after"), F.col("path"), model.language)).withColumn("score", F.expr(model.forest.sql(list(FEATURES))))
    return scored.select("doc_id", "start", F.length("found").cast("long").alias("length"), "found", F.sha2("found", 256).alias("sha256"), "score", (F.col("score") >= threshold).alias("is_secret"))


def mask(docs: DataFrame, model: SecretModel | None = None, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """``docs`` with every secret in the text replaced by ``[secret]``; rows of one id share its secrets,
    and rows with a null text pass through."""
    found = scan(docs, model, id_col=id_col, text_col=text_col, path_col=path_col, threshold=threshold).where("is_secret")
    lists = found.groupBy(F.col("doc_id").alias("__id")).agg(F.array_sort(F.collect_set("found"), lambda a, b: F.length(b) - F.length(a)).alias("__found"))
    joined = docs.join(lists, docs[id_col].eqNullSafe(lists["__id"]), "left")
    text = F.when(F.col("__found").isNull(), F.col(f"`{text_col}`")).otherwise(F.aggregate("__found", F.col(f"`{text_col}`"), lambda t, s: F.replace(t, s, F.lit("[secret]"))))
    return joined.select(*(text.alias(c) if c == text_col else docs[c] for c in docs.columns))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
