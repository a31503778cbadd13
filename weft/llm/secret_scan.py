"""Secret scans [native]: a random forest over measures of candidate strings.

Candidates come from one regular expression (known formats, values assigned to telling names, and long strings of
mixed characters). Each has measures of its length, character classes and their transitions, dictionary coverage,
path-like surroundings and neighbouring words, all of them DataFrame expressions; a forest trained on labelled
findings, compiled into one expression of nested conditions, gives the probability that it is a secret and removes
false positives. The text is cut at its candidates inside the row, so that findings, spans and redaction need no
shuffle and no user function.

Labelled findings are FINDINGS rows from a seeded generator (labelled_findings), or any frame of the same columns
that the caller has. Fitting on these few rows is done on the driver.

Defined results: null and empty texts have no findings; a text of any length is handled in its own row; equal
findings at different places are separate rows; repeated rows are scanned one by one; other columns, whatever their
names, are carried along by redacted(). No part of a candidate or of its measures is cut: names, values and keys end
only where their characters end, so that nothing of a masked value is left.
"""

from __future__ import annotations

import base64
import random
import string
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, local_rows

FINDINGS = 3000
TREES = 12
DEPTH = 6
THRESHOLD = 0.5
LEFT, RIGHT = 40, 20
MASK = "[SECRET]"
_PARTS, _SEGMENTS, _FOUND = "__weft_parts", "__weft_segments", "__weft_found"

# Formats of known credentials, names that announce one, and how a value is assigned to such a name.
KNOWN = [
    r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[\s\S]*?-----END (?:[A-Z]+ )*PRIVATE KEY-----",
    r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    r"gh[pousr]_[A-Za-z0-9]{20,}+",
    r"glpat-[A-Za-z0-9_-]{20,}+",
    r"xox[abprs]-[A-Za-z0-9-]{10,}+",
    r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}+",
    r"AIza[0-9A-Za-z_-]{35,}+",
    r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
]
NAMES = "password|passwd|pwd|passphrase|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth[_-]?key|credential|bearer"
ASSIGN = rf"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*?(?i:{NAMES}))[A-Za-z0-9_-]++[\"']?[ \t]*+(?:=>|:=|[:=])[ \t]*+[\"']?"
CANDIDATE = (
    "(?<![A-Za-z0-9_])(?:" + "|".join(KNOWN) + ")"
    rf"|{ASSIGN}[^\s\"',;<>(){{}}\[\]]{{6,}}+"
    r"|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"
)
BAD_WORDS = r"commit|sha-?\d*|md5|checksum|digest|revision|uuid|guid|integrity|etag|example|sample|dummy|placeholder|order|invoice|isbn|phone|card|hash|version|build|image|color"
HOLDERS = r"example|change_?me|your|dummy|placeholder|xxxx|12345|sample|foobar|todo|none|null|redacted|\*\*\*"
# Frequent words of prose, code and file names; coverage counts them inside a candidate.
DICTIONARY = """about above access account after again against align always another application array attribute author
available average back background banner base before begin below between block body border bottom build button cache
call camel card center change channel check child class click client close code color column common config content
context control count create current data database date default delete description detail device dialog direct display
document domain download driver dynamic edit element email enable entry error event example export extend factory false
field file filter find first float folder font foot form format frame from full function game general generate global
graph green group handler head height hello help hidden high history home host html http icon image import index
information input insert inside install instance integer interface internal item java join json just label language large
last layer layout left length level library light like line link list load local location login long main manager margin
mark master match matrix maximum media member memory menu message method middle minimum mobile model module month more
name native network next node normal note number object offset online open option order other output package page panel
param parent part password path pattern place player plugin point policy position post prefix primary print private
process product profile program project property public query random range read record region release remote remove
render report request require reset resource response rest result return right root route rule sample scale schema scope
screen script search second secret section select send server service session setting shape share sheet short should show
side simple single site size small sort source space span spring stack start state static status step stop storage store
stream string style submit success summary support switch system table target task template test text than that their
theme there thing this through time title token tool total track transaction transfer tree true type under unit update
upload user util valid value vector version view visible wait well when where white width window with word work world
wrap write year your zone""".split()

FEATURES = ["length", "digits", "uppers", "lowers", "symbols", "turns", "distinct", "hex", "words", "path", "named", "bad", "holder", "runs", "known", "assigned", "quoted"]


def _ratio(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.greatest(F.length(value), F.lit(1))


def measured(c: Column) -> Column:
    """Struct of the candidate (i, segment, value, left, right) and its measures; c has i, segment, left, right."""
    value = F.regexp_replace(c["segment"], f"^{ASSIGN}", "")
    lower, before = F.lower(value), F.lower(F.concat(c["left"], c["segment"]))
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    whole = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    return F.struct(
        c["i"].alias("i"),
        c["segment"].alias("segment"),
        value.alias("value"),
        F.length(value).cast("double").alias("length"),
        _ratio(value, "[0-9]").alias("digits"),
        _ratio(value, "[A-Z]").alias("uppers"),
        _ratio(value, "[a-z]").alias("lowers"),
        _ratio(value, "[^0-9A-Za-z]").alias("symbols"),
        _ratio(value, "(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])").alias("turns"),
        (F.size(F.array_distinct(F.split(value, ""))) / F.greatest(F.length(value), F.lit(1))).alias("distinct"),
        flag(value.rlike("^[0-9a-fA-F]+$")).alias("hex"),
        (1 - F.length(F.regexp_replace(lower, whole, "")) / F.greatest(F.length(value), F.lit(1))).alias("words"),
        flag(value.rlike(r"[/\\].*[/\\]|\.(?:com|org|net|html?|js|css|png|jpe?g|py|java)\b") | c["left"].rlike(r"[/\\.@]$") | c["right"].rlike(r"^[/\\@]|^\.[a-z]")).alias("path"),
        flag(before.rlike(rf"(?i)(?:{NAMES})\W{{0,4}}\w*$") | (value != c["segment"])).alias("named"),
        flag(F.lower(c["left"]).rlike(rf"\b(?:{BAD_WORDS})\b\W{{0,4}}(?:\w+\W{{1,3}})?$")).alias("bad"),
        flag(lower.rlike(HOLDERS)).alias("holder"),
        flag(value.rlike(r"(.)\1{4,}")).alias("runs"),
        flag(value.rlike("^(?:" + "|".join(KNOWN) + ")")).alias("known"),
        flag(value != c["segment"]).alias("assigned"),
        flag(c["right"].rlike("^[\"'`]") | c["left"].rlike("[\"'`]$")).alias("quoted"),
    )


def labelled_findings(n: int = FINDINGS, seed: int = 17) -> list[tuple[str, str, str, int]]:
    """(left, segment, right, label): a seeded mixture of real-looking secrets and of what is mistaken for them."""
    r = random.Random(seed)
    hexes, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    rand = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda: r.choice(DICTIONARY)
    prose = lambda: " ".join(word() for _ in range(r.randrange(1, 6)))
    name = lambda: r.choice(["password", "passwd", "secret", "token", "api_key", "access_key", "apikey", "auth_key", "client_secret", "db_password", "secret_key"])
    gibberish = lambda: "".join(rand("aeiou" if i % 2 else "bcdfglmnprstv", 1) for i in range(r.randrange(6, 30)))

    def assigned(value: str) -> tuple[str, str, str]:
        q = r.choice(["", '"', "'"])
        return f"{prose()} ", f"{name()}{r.choice([' = ', ': ', '=', ' := '])}{q}{value}", f"{q} {prose()}"

    def loose(value: str, before: str = "", after: str = "") -> tuple[str, str, str]:
        return f"{prose()} {before}", value, f"{after} {prose()}"

    def positive():
        k = r.randrange(12)
        if k < 3:
            return assigned(rand(hexes, r.choice([32, 40, 40, 40, 64])))
        if k < 6:
            return assigned(rand(alnum + r.choice(["", "-_", "!@#$%^&*"]), r.randrange(12, 48)))
        if k == 6:
            return loose("AKIA" + rand(string.ascii_uppercase + string.digits, 16))
        if k == 7:
            return loose("gh" + r.choice("pousr") + "_" + rand(alnum, 36))
        if k == 8:
            return loose(r.choice(["sk_live_", "rk_live_"]) + rand(alnum, 24)) if r.random() < 0.5 else loose("xoxb-" + rand(string.digits, 12) + "-" + rand(alnum, 24))
        if k == 9:
            return loose("AIza" + rand(alnum + "-_", 35)) if r.random() < 0.5 else loose(f"eyJ{rand(alnum, 20)}.eyJ{rand(alnum, 40)}.{rand(alnum + '-_', 43)}")
        if k == 10:
            return loose("-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(rand(alnum + "+/", 64) for _ in range(6)) + "\n-----END RSA PRIVATE KEY-----")
        return loose(rand(alnum + "+/", r.choice([32, 40, 44, 64])) + r.choice(["", "=", "=="]), before=f"{name()} ")

    def negative():
        k = r.randrange(14)
        if k == 0:
            return loose(rand(hexes, 40), before=r.choice(["commit ", "sha ", "revision ", "checksum: "]))
        if k == 1:
            return loose(rand(hexes, r.choice([32, 64])), before=r.choice(["md5 ", "sha256 ", "digest ", "etag: ", "integrity "]))
        if k == 2:
            return loose(str(uuid.UUID(int=r.getrandbits(128))), before=r.choice(["", "uuid ", "guid "]))
        if k == 3:
            return loose(rand(string.digits, r.randrange(20, 40)))
        if k == 4:
            return loose("/".join([word() for _ in range(4)] + [f"{word()}{r.randrange(99)}"]))
        if k == 5:
            return loose("_".join(word() for _ in range(4)) + str(r.randrange(100)))
        if k == 6:
            return loose("".join(word().title() for _ in range(4)) + str(r.randrange(100)))
        if k == 7:
            return loose("-".join(word() for _ in range(4)) + f"-{r.randrange(2000, 2030)}", before="https://www.example.com/", after="/")
        if k == 8:
            return assigned(r.choice(["changeme123", "your_token_here", "xxxxxxxxxxxxxxxx", "example_password", "********", "<redacted>1", "dummy-secret-value", "placeholder_1", "12345678", "none-none", "os.environ", "process.env.TOKEN", "get_password", "config.secret_key"]))
        if k == 9:
            return assigned(gibberish()[:24])
        if k == 10:
            return loose(base64.b64encode(" ".join(word() for _ in range(6)).encode()).decode(), before="data:image/png;base64,")
        if k == 11:
            return loose("=" * r.randrange(20, 60) + str(r.randrange(10)))
        if k == 12:
            return loose(gibberish() + gibberish() + str(r.randrange(10)))
        return loose(rand("01", r.randrange(20, 64)) if r.random() < 0.5 else f"2024-01-{r.randrange(10, 29)}T10-00-00-{word()}-{word()}")

    return [(*(positive() if i % 2 else negative()), i % 2) for i in range(n)]


def _tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int):
    """A leaf (probability) or (feature, threshold, below or equal, above), by Gini impurity."""
    p = float(y.mean())
    if depth == 0 or len(y) < 8 or p in (0.0, 1.0):
        return p
    best = None
    for j in rng.choice(x.shape[1], int(x.shape[1] ** 0.5) + 1, replace=False):
        order = np.argsort(x[:, j], kind="stable")
        v, ones = x[order, j], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] != v[:-1])
        if not len(at):
            continue
        n, left, a = len(y), at + 1, ones[at]
        right, b = n - left, ones[-1] - a
        gini = 2 * (a * (1 - a / left) + b * (1 - b / right)) / n
        k = int(gini.argmin())
        if best is None or gini[k] < best[0]:
            best = (float(gini[k]), int(j), float((v[at[k]] + v[at[k] + 1]) / 2))
    if best is None:
        return p
    _, j, cut = best
    low = x[:, j] <= cut
    return (j, cut, _tree(x[low], y[low], rng, depth - 1), _tree(x[~low], y[~low], rng, depth - 1))


def forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 29) -> list:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(_tree(x[rows], y[rows], rng, depth))
    return out


def _compiled(tree, f: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    j, cut, low, high = tree
    return F.when(f[FEATURES[j]] <= cut, _compiled(low, f)).otherwise(_compiled(high, f))


def probability(trees: list, f: Column) -> Column:
    """The forest as one expression: the mean of the trees' leaves for the measures in the struct f."""
    total = _compiled(trees[0], f)
    for t in trees[1:]:
        total = total + _compiled(t, f)
    return total / len(trees)


def trained(spark: SparkSession, findings: list[tuple[str, str, str, int]] | None = None) -> list:
    """A forest from labelled findings (left, segment, right, label), measured by the same expressions."""
    rows = local_rows(spark, findings or labelled_findings(), "left string, segment string, right string, y int")
    c = F.struct(F.lit(0).alias("i"), "segment", F.right("left", F.lit(LEFT)).alias("left"), F.left("right", F.lit(RIGHT)).alias("right"))
    got = rows.select("y", measured(c).alias("m")).select("y", *[F.col(f"m.{k}") for k in FEATURES]).collect()
    data = np.array([[float(v) for v in r] for r in got])
    return forest(data[:, 1:], data[:, 0])


def scanned(df: DataFrame, trees: list, text: str = "text") -> DataFrame:
    """df with the parts of its text between candidates, the candidates, and an array of structs (i, segment, value, p)
    of them; all null without candidates."""
    t = F.col(text)
    some = t.rlike(CANDIDATE)
    df = df.withColumns({_PARTS: F.when(some, F.split(t, CANDIDATE)), _SEGMENTS: F.when(some, F.regexp_extract_all(t, F.lit(f"({CANDIDATE})"), F.lit(0)))})
    parts, segments = F.col(_PARTS), F.col(_SEGMENTS)

    def candidate(segment: Column, i: Column) -> Column:
        return F.struct(i.alias("i"), segment.alias("segment"), F.right(parts[i], F.lit(LEFT)).alias("left"), F.left(parts[i + 1], F.lit(RIGHT)).alias("right"))

    found = F.transform(F.transform(F.transform(segments, candidate), measured), lambda f: F.struct(f["i"].alias("i"), f["segment"].alias("segment"), f["value"].alias("value"), f["known"].alias("known"), probability(trees, f).alias("p")))
    return df.withColumn(_FOUND, found)


def findings(df: DataFrame, trees: list, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, start, end, kind, value_sha256, masked, probability, is_secret): one row for each candidate."""
    rows = scanned(df.select(F.col(key).alias("k"), F.col(text).alias("t")), trees, "t").where(F.col(_FOUND).isNotNull())
    # what stands before the candidate's value: the parts and candidates before it, and the name that it is assigned to
    lengths = F.zip_with(_PARTS, _SEGMENTS, lambda p, s: F.length(p) + F.coalesce(F.length(s), F.lit(0)))
    ends = lambda f: F.aggregate(F.slice(lengths, F.lit(1), f["i"] + 1), F.lit(0), lambda n, x: n + x)
    spans = F.transform(F.col(_FOUND), lambda f: F.struct(f.alias("f"), (ends(f) - F.length(f["value"])).alias("start")))
    rows = rows.select("k", F.explode(spans).alias("r")).select("k", F.col("r.start").alias("start"), "r.f.*")
    return rows.select(
        F.col("k").alias(key),
        F.col("start").cast("bigint").alias("start"),
        (F.col("start") + F.length("value")).cast("bigint").alias("end"),
        F.when(F.col("known") > 0, "known_format").when(F.col("value") != F.col("segment"), "assigned").otherwise("loose").alias("kind"),
        F.sha2("value", 256).alias("value_sha256"),
        F.concat(F.left("value", F.lit(4)), F.lit("...")).alias("masked"),
        F.round("p", 6).alias("probability"),
        (F.col("p") >= threshold).alias("is_secret"),
    )


def redacted(df: DataFrame, trees: list, text: str = "text", threshold: float = THRESHOLD, mask: str = MASK) -> DataFrame:
    """df with the values of secrets in its text replaced by the mask; texts without secrets stay as they are."""
    kept = {c: free(df, f"_{c}") for c in (_PARTS, _SEGMENTS, _FOUND) if c in df.columns}
    columns = df.columns
    rows = scanned(df.withColumnsRenamed(kept), trees, text)
    clean = F.transform(
        F.col(_FOUND), lambda f: F.when(f["p"] >= threshold, F.concat(F.left(f["segment"], F.length(f["segment"]) - F.length(f["value"])), F.lit(mask))).otherwise(f["segment"])
    )
    whole = F.array_join(F.zip_with(_PARTS, clean, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    return rows.withColumn(text, F.when(F.exists(_FOUND, lambda f: f["p"] >= threshold), whole).otherwise(F.col(text))).drop(_PARTS, _SEGMENTS, _FOUND).withColumnsRenamed({v: k for k, v in kept.items()}).select(*columns)
