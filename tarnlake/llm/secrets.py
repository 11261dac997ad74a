"""Secret scans: candidates by pattern, false positives removed by a random forest.

The forest is grown from a table of labelled findings on the driver and runs as a SQL expression over
five features of a candidate: its length, the share of character transitions, how much of it
dictionary words cover, its path, and the words around it. DataFrame functions only.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import forest

# issuers' key formats, private keys (to their end, or where that is missing as far as their
# lines go), passwords in addresses, and assignments to names that tell of a secret. No part looks around
# itself, so a match can be found again by its text.
PATTERN = (
    r"A[KS]IA[0-9A-Z]{16}"
    r"|gh[pousr]_[A-Za-z0-9]{30,}"
    r"|github_pat_[A-Za-z0-9_]{22,}"
    r"|glpat-[A-Za-z0-9_-]{20,}"
    r"|hf_[A-Za-z0-9]{30,}"
    r"|npm_[A-Za-z0-9]{36}"
    r"|xox[abprs]-[A-Za-z0-9-]{10,}"
    r"|[rs]k_live_[A-Za-z0-9]{16,}"
    r"|sk-[A-Za-z0-9]{32,}"
    r"|SG[.][A-Za-z0-9_-]{16,}[.][A-Za-z0-9_-]{16,}"
    r"|AIza[A-Za-z0-9_-]{30,}"
    r"|eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{5,}"
    r"|-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:[A-Za-z0-9+/=\s:,.()@_-]*?-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
    r"|(?:\s*Proc-Type: [^\n]*)?(?:\s*DEK-Info: [^\n]*)?[A-Za-z0-9+/=\r\n]*)"
    r"|[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@\"']*:[^\s/@\"']{2,}@"
    r"|(?:[Tt][Oo][Kk][Ee][Nn]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Pp][Aa][Ss][Ss][Ww][Oo]?[Rr]?[Dd]|[Aa][Pp][Ii]_?-?[Kk][Ee][Yy]|[Aa][Cc][Cc][Ee][Ss][Ss]_?-?[Kk][Ee][Yy])"
    r"[\"']?[ \t]*[:=]>?[ \t]*(?:\"[^\"\s]{8,}|'[^'\s]{8,}|[A-Za-z0-9+/_.=-]{8,})"
)
#: The value of an assignment: what follows the first sign, with or without a quote.
VALUE = r"[:=]>?[ \t]*(?:\"([^\"\s]{8,})|'([^'\s]{8,})|([A-Za-z0-9+/_.=-]{8,}))$"
#: The password of an address; an at sign follows it.
PASSWORD = r"://[^\s:/@]*:([^@]*)@$"
#: Cheap test that every text with a match passes; most texts end here.
CUE = r"A[KS]IA|gh[pousr]_|github_pat_|glpat-|hf_|npm_|xox[abprs]-|k_live_|sk-|SG[.]|AIza|eyJ|PRIVATE KEY|://[^\s:/@]*:[^\s/@]+@|[Tt][Oo][Kk][Ee][Nn]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Pp][Aa][Ss][Ss][Ww]|[Kk][Ee][Yy]"
#: Issuers' formats and passwords of addresses, where the pattern alone is strong evidence.
ISSUED = r"^(A[KS]IA|gh[pousr]_|github_pat_|glpat-|hf_|npm_|xox[abprs]-|[rs]k_live_|sk-|SG[.]|AIza|eyJ|-----BEGIN|[A-Za-z][A-Za-z0-9+.-]*://)"
# Parts of placeholders and of common code; words near examples and in their paths.
DICTIONARY = ["example", "sample", "placeholder", "changeme", "password", "secret", "token", "value", "string", "insert", "here", "your", "dummy", "test", "default", "admin", "user", "none", "null", "undefined", "true", "false", "config", "environ", "getenv", "process", "settings", "variable", "function", "return", "access", "hidden", "redacted", "qwerty", "letmein", "hello", "world", "abcdef", "123456", "xxxx", "0000"]
DOUBTFUL = "examples?|samples?|dummy|placeholders?|fake|tests?|mock|replace|documentation|demo"
PATHS = "tests?|examples?|samples?|docs?|mocks?|fixtures?|readme|demos?"
FEATURES = ["length", "transitions", "coverage", "doubtful_path", "doubtful_words", "issued"]
THRESHOLD = 0.5
#: Characters looked at on either side of a candidate.
AROUND = 48
MASK = "[SECRET]"


def whole(words: str) -> str:
    """A pattern for any of the words where no letter or digit adjoins it."""
    return f"(^|[^a-z0-9])({words})([^a-z0-9]|$)"


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2


def describe(candidate: str, around: str, path: str, issued: bool) -> dict[str, float]:
    """The features in plain Python, for the labelled findings."""
    low = candidate.lower()
    rest = low
    for word in DICTIONARY:
        rest = rest.replace(word, "")
    kinds = [_class(c) for c in candidate if c.isascii() and c.isalnum()]  # separators part words, not kinds
    return {
        "length": float(len(candidate)),
        "transitions": sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, len(kinds) - 1),
        "coverage": 1 - len(rest) / max(1, len(low)),
        "doubtful_path": float(bool(re.search(whole(PATHS), path.lower()))),
        "doubtful_words": float(bool(re.search(whole(DOUBTFUL), around.lower()))),
        "issued": float(issued),
    }


def labelled_findings(n: int = 2400, seed: int = 11) -> list[dict[str, float]]:
    """Synthetic reviewed findings: random keys of usual alphabets are secrets; placeholders, code, words and keys shown as examples are not."""
    rng = random.Random(seed)
    alphabets = ["0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", "01234567890123456789abcdef"]
    parts = ["con", "ver", "ing", "ter", "ment", "able", "pre", "tion", "der", "sub", "or", "ly", "est", "un"]
    plain_paths, odd_paths = ["src/app.py", "src0/12", "config/prod.yml", "lib/net.go"], ["tests/test_a.py", "docs/readme.md", "examples/run.sh", "fixtures/keys.json"]
    beside = [" write to ops@example.com about ", " passed the last test and then ", " a demo for the board, ", " see the documentation "]
    out = []
    for i in range(n):
        kind = i % 9
        path, around, issued, label = rng.choice(plain_paths), " the value is set to = ", False, 0
        if kind == 6:  # an issuer's format, at times without any digit
            text = "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ" + rng.choice(["", "234567", "0123456789"]), k=16))
            issued, label = True, 1
            if rng.random() < 0.5:
                text = rng.choice(["ghp_", "glpat-", "hf_", "npm_", "xoxb-", "sk_live_"]) + "".join(rng.choices(rng.choice(alphabets[1:3]), k=rng.randrange(20, 41)))
            if rng.random() < 0.15:
                text, around, path, label = text[:-7] + "EXAMPLE", " sample keys ", rng.choice(odd_paths), 0
            elif rng.random() < 0.3:
                around = rng.choice(beside)
        elif kind == 7:  # a password in an address
            text, issued, label = "".join(rng.choices(alphabets[1] + "!$%*-_", k=rng.randrange(4, 20))), True, 1
            if rng.random() < 0.3:
                text, label = "".join(rng.sample(DICTIONARY, rng.randrange(1, 3))), 0
            elif rng.random() < 0.3:
                text, around = rng.choice(parts).capitalize() + rng.choice(parts) + str(rng.randrange(10, 9999)), rng.choice(beside)
        elif kind == 8:  # a quoted password with other signs
            text, label = "".join(rng.choices(alphabets[1] + "!#$%&*?@^~+=", k=rng.randrange(10, 30))), 1
            if rng.random() < 0.2:
                text, label = rng.choice(["${%s}", "{{%s}}", "<%s>", "%%(%s)s"]) % "_".join(rng.sample(DICTIONARY, 2)), 0
        elif kind <= 2:
            text = "".join(rng.choices(rng.choice(alphabets), k=rng.randrange(12, 65)))
            issued, label = rng.random() < 0.3, 1
            if rng.random() < 0.2:  # a real-looking key in an example
                path, around, label = rng.choice(odd_paths), " for example replace this dummy ", 0
            elif rng.random() < 0.2:
                path = rng.choice(odd_paths)
            elif rng.random() < 0.3:  # a real key whose neighbours say nothing of it
                around = rng.choice(beside)
        elif kind == 3:
            words = rng.sample(DICTIONARY, rng.randrange(1, 4))
            text = rng.choice(["_", "-", ".", ""]).join(words) + rng.choice(["", "1", "123", "xxxxxxxx"])
            around = rng.choice([around, " sample only "])
        elif kind == 4:
            text = rng.choice(["", "_", "."]).join(rng.choices(parts, k=rng.randrange(3, 8)))
        else:
            text = rng.choice(["config.", "os.environ.", "self.", "process.env.", "settings."]) + "_".join(rng.choices(parts + DICTIONARY, k=2))
        text = text if issued or len(text) >= 8 else text + "x" * (8 - len(text))
        out.append(describe(text, around, path, issued) | {"label": label})
    return out


@lru_cache
def default_forest() -> tuple:
    return tuple(forest.grow(labelled_findings(), FEATURES))


def _lower(value: Column) -> Column:
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Matches have this many characters at least, so so many of them and the texts between hold AROUND characters.
LEAST = 8
NEAR = 2 * (AROUND // LEAST + 1) + 1


def _line(text: Column) -> Column:
    """The text in turn: what stands before a match, the match, ..., what stands after the last one. Each character is looked at once."""
    between, found = F.split(text, PATTERN, -1), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    return F.flatten(F.zip_with(between, found, lambda part, match: F.when(match.isNull(), F.array(part)).otherwise(F.array(part, match))))


def _starts(sizes: Column, group: int = 64) -> Column:
    """For each size the sum of those before it, by groups, so that no array grows part by part."""
    add, zero = (lambda n, x: n + x), F.lit(0).cast("long")
    groups = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / group).cast("int"))
    own = lambda g, n: F.slice(sizes, g * group + 1, n)
    sums = F.transform(groups, lambda g: F.aggregate(own(g, F.lit(group)), zero, add))
    begins = F.aggregate(sums, F.array(zero), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))
    each = lambda begin, g: F.transform(own(g, F.lit(group)), lambda _, j: begin + F.aggregate(own(g, j), zero, add))
    return F.flatten(F.zip_with(F.slice(begins, 1, F.size(groups)), groups, each))


def _value(match: Column) -> Column:
    """The part of a match that is the secret: a password or value, else all of it. It ends where the match ends, but for an address's at sign."""
    whole_match = F.when(match.rlike(ISSUED), match).otherwise(F.concat(*[F.regexp_extract(match, VALUE, i) for i in (1, 2, 3)]))
    return F.when(match.rlike(PASSWORD), F.regexp_extract(match, PASSWORD, 1)).otherwise(whole_match)


def _parts(line: Column, sizes: Column) -> Column:
    """For each match of the line: where its value starts, the value, whether an issuer's format, and the words around.

    Arrays that are made here are arguments, never looked up in a lambda, where they would be made for each match.
    """

    def part(at: Column, i: Column) -> Column:
        match = F.get(line, i)
        issued = match.rlike(ISSUED)
        value, tail = _value(match), F.when(match.rlike(PASSWORD), 1).otherwise(0)
        first = F.greatest(i - NEAR, F.lit(0))
        before = F.right(F.array_join(F.slice(line, first + 1, i - first), ""), F.lit(AROUND))
        after = F.left(F.array_join(F.slice(line, i + 2, F.lit(NEAR)), ""), F.lit(AROUND))
        return F.struct((at + F.length(match) - F.length(value) - tail).alias("start"), value.alias("candidate"), issued.alias("issued"), _lower(F.concat(before, F.lit(" "), after)).alias("around"))

    odd = F.filter(_starts(sizes), lambda _, i: i % 2 == 1)
    return F.transform(odd, lambda at, j: part(at, 2 * j + 1))


def _features(path: Column):
    odd = _lower(path).rlike(whole(PATHS)).cast("double")

    def features(part: Column) -> Column:
        value = part["candidate"]
        size, low = F.length(value), _lower(value)
        for word in DICTIONARY:
            low = F.replace(low, F.lit(word), F.lit(""))
        plain = F.regexp_replace(value, "[^0-9a-zA-Z]", "")
        runs = plain
        for kind, letter in (("[0-9]+", "0"), ("[a-z]+", "a"), ("[A-Z]+", "A")):
            runs = F.regexp_replace(runs, kind, letter)
        changes = F.greatest(F.lit(0), F.length(runs) - 1) / F.greatest(F.lit(1), F.length(plain) - 1)
        return F.struct(
            part["start"].alias("start"), (part["start"] + size).alias("finish"), value.alias("candidate"),
            size.cast("double").alias("length"), changes.alias("transitions"),
            (1 - F.length(low) / F.greatest(F.lit(1), size)).alias("coverage"), odd.alias("doubtful_path"),
            part["around"].rlike(whole(DOUBTFUL)).cast("double").alias("doubtful_words"), part["issued"].cast("double").alias("issued"),
        )

    return features


def _with_findings(docs: DataFrame, trees: list | tuple | None, threshold: float) -> DataFrame:
    """doc, a struct of all columns of docs, with line and found, an array of (start, finish, candidate, features, score, secret); null without a match."""
    text, path = F.col("doc.text"), F.coalesce(F.col("doc.path").cast("string"), F.lit("")) if "path" in docs.columns else F.lit("")
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    out = out.withColumn("line", F.when(text.rlike(CUE), _line(text)))
    out = out.withColumn("line", F.when(F.size("line") > 1, F.col("line")))
    out = out.withColumn("sizes", F.transform("line", lambda part: F.length(part).cast("long")))
    out = out.withColumn("found", F.when(F.col("line").isNotNull(), _parts(F.col("line"), F.col("sizes"))))
    out = out.withColumn("found", F.transform("found", _features(path)))
    fields = ", ".join(f"'{c}', f.{c}" for c in ("start", "finish", "candidate", *FEATURES))
    vote = forest.sql(list(trees or default_forest()), "f.")
    out = out.withColumn("found", F.expr(f"transform(found, f -> named_struct({fields}, 'score', {vote}))"))
    return out.withColumn("found", F.transform("found", lambda f: f.withField("secret", f["score"] >= threshold)))


def scan(docs: DataFrame, trees: list | tuple | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs (text, path and any columns) to one row for each candidate: docs' columns but the text, with start, finish, candidate, the features, score and secret.

    start and finish are places of characters in the whole text. Null and empty texts have no
    candidates; a null or missing path is empty. Repeated rows are scanned each. Columns of docs that
    are named as the result's are replaced.
    """
    own = ["start", "finish", "candidate", *FEATURES, "score", "secret"]
    found = _with_findings(docs.drop(*own), trees, threshold)
    rows = found.select("doc", F.explode_outer("found").alias("f")).filter(F.col("f").isNotNull())
    return rows.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in ("text", *own)], "f.*")


def redact(docs: DataFrame, trees: list | tuple | None = None, threshold: float = THRESHOLD, mask: str = MASK) -> DataFrame:
    """docs with each secret of the text replaced by ``mask``; all rows and other columns stay as they are, whatever their names."""
    found = _with_findings(docs, trees, threshold)

    def put(part: Column, i: Column) -> Column:
        f = F.get("found", F.floor(i / 2).cast("int"))
        tail = F.when(part.rlike(PASSWORD), 1).otherwise(0)
        masked = F.concat(F.left(part, F.length(part) - F.length(f["candidate"]) - tail), F.lit(mask), F.right(part, tail))
        return F.when((i % 2 == 1) & f["secret"], masked).otherwise(part)

    text = F.when(F.exists("found", lambda f: f["secret"]), F.array_join(F.transform("line", put), "")).otherwise(F.col("doc.text"))
    return found.withColumn("text", text).select(*[F.col("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
