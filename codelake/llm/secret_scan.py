"""Secret scans: a high-recall generator and a random forest that removes false positives.

Candidates are runs of key characters in the words of a whole text and,
after a key word and ``=``, ``:`` or a quote, the whole value up to the blank
or the closing quote, whatever its signs and length.  Each
has features of its own (length, character transitions, letter pairs,
dictionary coverage, shape), of the path it looks like or comes from, and
of its neighbouring words.  A random forest trained on labelled findings
votes; candidates above ``THRESHOLD`` are findings.

Everything is DataFrame operations.  A text is scanned in its own row: the
forest travels as four literal arrays and is walked by array functions, so
scanning needs no shuffle and no join.

Labelled findings are a table (text, source, value, label).  The given
tables hold none, so ``labelled_findings`` makes a bounded, seeded one from
formats of secrets and of what is mistaken for them; pass your own to
``train`` instead.

Defined cases: a very long text is worked on whole, in one task; null text counts as empty and gives no finding; repeated
rows give their findings each; a null source gives no path evidence; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
CORE = r"[A-Za-z0-9+/_.~\-]{8,}"
#: a core that may be a secret by itself
LIKELY = r"(?=[A-Za-z+/_.~\-]*[0-9])[A-Za-z0-9+/_.~\-]{8,}|[A-Za-z0-9+/_.~\-]{20,}"
KEY_WORD = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|key|credential|auth|bearer)"
NOT_KEY_WORD = (r"(?i)(commit|sha-?[0-9]*|md5|checksum|digest|hash|uuid|guid|version|revision|build|example|sample|placeholder|dummy|"
                r"test|changeme|your|order|invoice|card|phone|isbn|file|path|url|href|src|image|page|chapter|session_?id)")
_SIGN = r"[=:]++>?+"
#: a key word and its value in one word; groups 4 (quoted) and 5 hold the value
KEYED = KEY_WORD + r"\w*(?:[\"'`]?+" + _SIGN + r"|(?=[\"'`][^=:,;)\]}]))(?:([\"'`])(?=((?:(?!\3).)+))|(?![\"'`])(?=(.+)))"
#: a word after a key word; groups: sign, quote, value in quotes, value without
_VALUE = r"^((?:" + _SIGN + r")?+)(?:([\"'`])((?:(?!\2).)+)|(?![\"'`])(.+))"
THRESHOLD = 0.5
TREES, DEPTH, SEED = 25, 7, 7
FINDINGS = 6000                # size of the default labelled table

# Published formats of keys.
KNOWN = (
    ("aws_access_key", r"^(AKIA|ASIA)[A-Z0-9]{16}$"),
    ("github_token", r"^gh[pousr]_[A-Za-z0-9]{30,}$"),
    ("slack_token", r"^xox[abprs]-[A-Za-z0-9-]{10,}$"),
    ("google_api_key", r"^AIza[A-Za-z0-9_-]{30,}$"),
    ("stripe_key", r"^[rs]k_live_[A-Za-z0-9]{16,}$"),
    ("json_web_token", r"^eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}"),
)
COMMON_PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra"
DICTIONARY = ("password passwd secret token example sample test user admin name value key your here change default config data file "
              "image page index main public static version release build order number account service server client string object "
              "section chapter table content style script module package library function class method error message report "
              "document license copyright government international information development organization http https www com org net html")


def _share(text: Column, pattern: str) -> Column:
    n = F.length(text)
    return (n - F.length(F.regexp_replace(text, pattern, ""))) / n


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("double")


def candidates(words: Column, source: Column) -> Column:
    """array<struct<word, value, left, next, source, at>> of a text's words; ``at`` stands before the value in its word.

    Whole values come before the runs of their word."""
    def possible(i: Column) -> Column:
        w, last = F.get(words, i), F.coalesce(F.get(words, i - 1), F.lit(""))
        return (i < F.size(words)) & (((F.length(w) >= 8) & w.rlike(LIKELY)) | w.rlike("[=:\"'`]") | last.rlike("[=:>\"'`]$"))

    def at(i: Column) -> Column:
        w = F.get(words, i)
        before = [F.coalesce(F.get(words, i - k), F.lit("")) for k in (3, 2, 1)]

        def one(value: Column, head: Column, at: Column) -> Column:
            return F.struct(i.cast("int").alias("word"), value.alias("value"),
                            F.concat_ws(" ", *before, head).alias("left"),
                            F.coalesce(F.get(words, i + 1), F.lit("")).alias("next"), source.alias("source"), at.alias("at"))

        def inside(z: Column) -> Column:
            value = F.concat(z["quoted"], z["plain"])
            return one(value, F.concat(F.call_function("substring_index", w, F.concat(z["at"], value), F.lit(1)), z["at"]), z["at"])

        keyed = F.arrays_zip(*[F.regexp_extract_all(w, F.lit(KEYED), F.lit(g)).alias(n) for g, n in ((0, "at"), (4, "quoted"), (5, "plain"))])
        own = F.when(w.rlike("[=:\"'`]"), F.transform(keyed, inside))
        sign, quote, quoted, plain = (F.regexp_extract(w, _VALUE, g) for g in (1, 2, 3, 4))
        near = F.concat_ws(" ", *before[1:])
        after = near.rlike(KEY_WORD + r"\w*[\"'`]?\s?[=:]+>?\s?[\"'`]?$") | (near.rlike(KEY_WORD + r"\w*[\"'`]?$") & ((sign != "") | (quote != "")))
        head = F.concat(sign, quote)
        next_word = F.when((F.concat(quoted, plain) != "") & after, F.array(one(F.concat(quoted, plain), head, head)))
        runs = F.transform(F.array_distinct(F.regexp_extract_all(w, F.lit(CORE), F.lit(0))),
                           lambda c: one(c, F.call_function("substring_index", w, c, F.lit(1)), F.lit("")))
        runs = F.filter(runs, lambda c: (F.length(w) >= 8) & (
            c["value"].rlike(LIKELY) | c["left"].rlike(KEY_WORD + r"\w*[\"']?\s?[=:]\s?[\"']?$")))
        none = F.slice(runs, 1, 0)
        whole = F.concat(F.coalesce(own, none), F.coalesce(next_word, none))
        return F.aggregate(F.concat(whole, runs), none, lambda out, c: F.when(
            F.exists(out, lambda o: o["value"] == c["value"]), out).otherwise(F.concat(out, F.array(c))))

    return F.flatten(F.transform(F.filter(F.sequence(F.lit(0), F.size(words)), possible), at))


def features(c: Column) -> Column:
    """The forest's inputs for one candidate."""
    v, left = c["value"], c["left"]
    n = F.length(v)
    runs = F.length(F.regexp_replace(v, "[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+", "x"))
    known = F.lit(False)
    for _, pattern in KNOWN:
        known = known | v.rlike(pattern)
    return F.array(
        n.cast("double"),
        runs / n,                                                            # character transitions
        _share(F.lower(v), COMMON_PAIRS.replace(" ", "|")),
        _share(F.lower(v), DICTIONARY.replace(" ", "|")),                    # dictionary coverage
        _share(v, "[0-9]"), _share(v, "[A-Z]"), _share(v, "[a-z]"),
        F.size(F.array_distinct(F.split(v, ""))) / n,
        _flag(v.rlike("^[0-9a-f]+$|^[0-9A-F]+$")), _flag(v.rlike(r"^[0-9.\-]+$")),
        _flag(v.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")),
        _flag(v.rlike(r"(.)\1{3,}")), _flag(known),
        _share(v, "/"), _share(v, r"[.\-_]"),                                # path
        _flag(v.rlike(r"/.*/|\.[a-z]{2,4}$|^www\.|^[a-z]+\.[a-z]+")),
        _flag(left.rlike(r"(?i)https?:|www\.|href|src=|@$")),
        _flag(c["source"].rlike("(?i)test|example|sample|fixture|mock")),
        _flag(left.rlike(KEY_WORD + r"\w*[\"']?\s?([=:]|is)?\s?[\"']?$")),   # neighbouring words
        _flag(left.rlike(KEY_WORD)), _flag(left.rlike(NOT_KEY_WORD)),
        _flag(left.rlike(r"[=:]\s?[\"'`]?$")), _flag(left.rlike("[\"'`]$")),
        _flag(c["next"].rlike(NOT_KEY_WORD)),
        _share(v, "[^A-Za-z0-9]"),                                           # signs
        sum(_flag(v.rlike(p)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")),
        _flag(v.rlike(r"^[<{$%(\[]|[)>}\]][,;.]?$|[(\[{]|^[^A-Za-z0-9]+$|^[a-z_]+\.[a-z_.]+[,;]?$")),
        _flag(v.rlike("^[A-Z]?[a-z]+[^A-Za-z0-9]*$")),
    )


def _split(docs: DataFrame, *keep: str) -> DataFrame:
    """Rows with ``words``; the explode keeps the optimiser from copying the split into every use of it."""
    d = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("source").cast("string").alias("source"))
    return d.select(*keep, "text", "source", F.explode(F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("words"))


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """A seeded table of labelled findings: text, source, value, label."""
    def noise(salt: str) -> Column:
        return F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)

    def pick(options: list[str], salt: str) -> Column:
        k = F.conv(F.substring(noise(salt), 1, 6), 16, 10).cast("int") % len(options) + 1
        return F.element_at(F.array(*[F.lit(o) for o in options]), k)

    hexes = noise("h")
    mixed = F.regexp_replace(F.concat(F.base64(F.unhex(noise("m"))), F.base64(F.unhex(noise("n")))), "[+/=]", "")
    digits = F.regexp_replace(F.concat(noise("d"), noise("e")), "[a-f]", "")
    def as_columns(rows: DataFrame, **made: Column) -> DataFrame:
        """Adds columns; the explode keeps the optimiser from copying them into every use of them."""
        own = F.explode(F.array(F.struct(*[c.alias(k) for k, c in made.items()]))).alias("b")
        return rows.select(*rows.columns, own).select(*rows.columns, *[F.col(f"b.{k}").alias(k) for k in made])

    rows = as_columns(spark.range(0, n, 1, 1), hexes=hexes, mixed=mixed, digits=digits)
    hexes, mixed, digits = F.col("hexes"), F.col("mixed"), F.col("digits")
    lower = F.lower(mixed)
    upper = F.upper(mixed)
    long_word = F.concat(pick(["inter", "over", "under", "counter", "trans", "micro"], "a"), pick(["national", "connection", "processing", "organization"], "b"),
                         pick(["development", "management", "information"], "c"))
    key = pick(["password", "passwd", "PASSWORD", "db_password", "pwd"], "k")
    tok = pick(["token", "auth_token", "api_key", "apiKey", "secret", "client_secret", "access_key", "API_KEY"], "t")
    quote = pick(["\"", "'", ""], "q")
    size = F.conv(F.substring(noise("s"), 1, 2), 16, 10).cast("int")
    h = lambda k: F.substring(hexes, 1, k)
    sign, other_sign = (pick(list("!@#$%&*?^+;,)("), x) for x in "fg")
    joint = pick(["=", ": ", " = ", ":", "=="], "j")
    after_key = lambda v: (F.concat(key, joint, quote, v, quote), v)
    any_key = F.concat(pick(["password", "key", "token", "Author", "auth", "secret", "passwd", "Key", "Keywords", "Authorization", "api_key", "credentials"], "K"), joint)
    plain = pick(["required", "the", "none", "None", "null", "true", "False", "name", "value", "yes", "enter", "here", "and", "forgotten", "reset",
                  "string", "field", "missing", "expired", "invalid", "policy", "Bearer", "Basic", "Jane", "Miller,", "see", "is", "it.", "data,",
                  "your", "must", "str,", "int", "admin,", "who", "lorem", "de", "der", "que", "un", "A", "x", "hidden", "unknown", "empty;"], "P")
    holder = pick(["<password>", "${PASSWORD}", "$DB_PASSWORD", "{{token}}", "********", "os.environ['KEY']", "getpass()", "%(password)s", "self.token",
                   "args.password,", "config['secret']", "...", "get_token()", "[hidden]", "<your-key>", "{secret}", "%s", "***", "####", "$(cat", "request.args;",
                   "(see", "lambda", "settings.API_KEY", "f(x)", "--", "{}", "[]", "<none>", "user.name"], "H")
    rows = as_columns(rows, lower=lower, upper=upper, long_word=long_word, key=key, tok=tok, quote=quote, size=size, sign=sign,
                      other_sign=other_sign, joint=joint, any_key=any_key, plain=plain, holder=holder)
    lower, upper, long_word, key, tok, quote, size, sign, other_sign, joint, any_key, plain, holder = (
        F.col(c) for c in ("lower", "upper", "long_word", "key", "tok", "quote", "size", "sign", "other_sign", "joint", "any_key", "plain", "holder"))
    made_up = F.substring(F.translate(hexes, "0123456789abcdef", "aeioutnrshldetio"), F.lit(1), 18 + F.length(long_word) % 20)
    signed = F.concat(F.substring(mixed, F.lit(1), 2 + size % 6), sign, F.substring(mixed, F.lit(12), 2 + size % 5), other_sign, F.substring(digits, F.lit(1), 1 + size % 3))
    spoken = F.concat(pick(["Summer", "Winter", "dragon", "Welcome", "hunter", "P@ss", "S3cret", "monkey", "Passw0rd", "w0rd"], "v"),
                      F.substring(digits, F.lit(1), 1 + size % 4), pick(["", "!", "#", "$x", "@", "!x$", "&7k"], "o"), F.substring(mixed, F.lit(30), size % 5))
    short = F.concat(F.substring(mixed, F.lit(1), 2 + size % 4), F.substring(digits, 1, 1), F.substring(mixed, 9, 1))
    rows = as_columns(rows, made_up=made_up, signed=signed, spoken=spoken, short=short)
    made_up, signed, spoken, short = (F.col(c) for c in ("made_up", "signed", "spoken", "short"))
    secrets = [
        (F.concat(key, F.lit("="), F.substring(lower, F.lit(1), 8 + size % 16)), F.substring(lower, F.lit(1), 8 + size % 16)),
        (F.concat(key, F.lit("="), h(16)), h(16)),
        (F.concat(key, F.lit(": "), quote, F.substring(mixed, F.lit(1), 9 + size % 16), quote), F.substring(mixed, F.lit(1), 9 + size % 16)),
        (F.concat(tok, F.lit(" = "), quote, h(40), quote), h(40)),
        (F.concat(tok, F.lit("="), quote, h(32), quote), h(32)),
        (F.concat(tok, F.lit(": "), quote, F.substring(mixed, 1, 32), quote), F.substring(mixed, 1, 32)),
        (F.concat(tok, F.lit(" = "), quote, F.substring(mixed, 1, 40), quote), F.substring(mixed, 1, 40)),
        (F.concat(pick(["AKIA", "ASIA"], "p"), F.substring(upper, 1, 16)), F.concat(pick(["AKIA", "ASIA"], "p"), F.substring(upper, 1, 16))),
        (F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)), F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36))),
        (F.concat(F.lit("sk_live_"), F.substring(mixed, 1, 24)), F.concat(F.lit("sk_live_"), F.substring(mixed, 1, 24))),
        (F.concat(F.lit("Authorization: Bearer "), F.substring(mixed, 1, 40)), F.substring(mixed, 1, 40)),
        after_key(signed), after_key(spoken), after_key(short), after_key(F.concat(F.substring(lower, 1, 3), sign, F.substring(mixed, 5, 6), other_sign)),
    ]
    harmless = [
        (F.concat(F.lit("commit "), h(40)), h(40)), (F.concat(F.lit("sha256: "), hexes), hexes), (F.concat(F.lit("md5 "), h(32)), h(32)),
        (F.concat(F.lit("see revision "), h(12), F.lit(" of it")), h(12)),
        (F.concat_ws("-", h(8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12)), None),
        (F.concat(F.lit("https://www.example.com/"), F.substring(lower, 1, 10), F.lit("/index12.html")), None),
        (F.concat(F.lit("src/main/module"), F.substring(digits, 1, 2), F.lit("/file"), F.substring(digits, 3, 3), F.lit(".py")), None),
        (F.concat(F.lit("the "), F.substring(digits, 1, 16), F.lit(" of it")), F.substring(digits, 1, 16)),
        (F.concat(F.lit("order number "), F.substring(digits, 1, 10)), F.substring(digits, 1, 10)),
        (F.concat(F.lit("on 2021-"), F.substring(digits, 1, 2), F.lit("-"), F.substring(digits, 3, 2), F.lit(" there")), None),
        (F.concat(F.substring(digits, 1, 2), F.lit("."), F.substring(digits, 3, 3), F.lit("."), F.substring(digits, 6, 3), F.lit("."), F.substring(digits, 9, 2)), None),
        (F.concat(F.lit("that."), F.substring(digits, 1, 2), F.lit("@mail"), F.substring(digits, 3, 1), F.lit(".example.com")), None),
        (F.concat(F.lit("+1 ("), F.substring(digits, 1, 3), F.lit(") 555-"), F.substring(digits, 4, 4)), None),
        (F.concat(F.lit("the "), long_word), long_word), (F.concat(F.lit("a "), long_word, F.lit("2021")), F.concat(long_word, F.lit("2021"))),
        (F.concat(key, F.lit("=your_password_here")), F.lit("your_password_here")), (F.concat(key, F.lit("=xxxxxxxxxxxx")), F.lit("xxxxxxxxxxxx")),
        (F.concat(tok, F.lit(" = \"example_token_value\"")), F.lit("example_token_value")),
        (F.concat(tok, F.lit(" = config.section.value12")), None), (F.concat(F.lit("version v1."), F.substring(digits, 1, 2), F.lit(".0-release")), None),
        (F.concat(F.lit("id=section"), F.substring(digits, 1, 3)), None), (F.concat(F.lit("note: "), long_word), long_word),
        (F.concat(any_key, plain), None), (F.concat(any_key, plain), None), (F.concat(any_key, quote, plain, quote), None), (F.concat(any_key, holder), None),
        (F.concat(any_key, quote, holder, quote), None), (F.concat(any_key, F.initcap(F.substring(made_up, F.lit(1), 2 + size % 9))), None),
        (F.concat(any_key, F.substring(made_up, F.lit(1), 2 + size % 9), pick(["", ",", ".", ";"], "e")), None),
        (made_up, made_up), (F.initcap(made_up), F.initcap(made_up)), (F.concat(F.lit("de "), made_up, F.lit(". Un")), F.concat(made_up, F.lit("."))),
    ]

    def either(options: list[tuple], salt: str) -> Column:
        k = F.conv(F.substring(noise(salt), 1, 6), 16, 10).cast("int") % len(options) + 1
        return F.element_at(F.array(*[F.struct(t.alias("text"), (t if v is None else v).alias("value")) for t, v in options]), k)

    is_secret = F.col("id") % 2 == 0
    fill = ["the value of it", "and then in the", "ou de la", "is that with", "der die und", "que el en", "", "was on ### the"]
    rows = as_columns(rows, secret=either(secrets, "y"), other=either(harmless, "y"), before=pick(fill, "x"), after=pick(fill, "z"),
                      source=pick(["src0", "web", "docs", "tests/fixture", "example", "crawl"], "w"))
    one = F.when(is_secret, F.col("secret")).otherwise(F.col("other"))
    return rows.select(F.concat_ws(" ", "before", one["text"], "after").alias("text"), "source",
                       F.when(is_secret, F.col("secret.value")).alias("value"), is_secret.alias("label"))


class Forest:
    """A trained forest as arrays: feature (-1 at a leaf), threshold or vote, left and right child; roots of the trees."""

    def __init__(self, debug: list[str]) -> None:
        self.feature: list[int] = []
        self.value: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.roots, self.depth = [], 1
        for text in debug:
            lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if re.search("If|Else|Predict", x)]
            self.roots.append(self._node(iter(lines), 0))

    def _node(self, lines, level: int) -> int:
        _, line = next(lines)
        me = len(self.feature)
        for x, v in ((self.feature, -1), (self.value, 0.0), (self.left, me), (self.right, me)):
            x.append(v)
        self.depth = max(self.depth, level)
        m = re.match(r"If \(feature (\d+) <= ([-0-9.E]+)\)", line)
        if not m:
            self.value[me] = float(line.split(":")[1])
            return me
        self.feature[me], self.value[me] = int(m[1]), float(m[2])
        self.left[me] = self._node(lines, level + 1)
        next(lines)                                            # the Else line
        self.right[me] = self._node(lines, level + 1)
        return me

    def vote(self, f: Column) -> Column:
        """The share of trees that call a candidate with features ``f`` a secret."""
        # one literal an array: folded into an array constant, where a thousand literals would burden every plan
        feature, left, right, roots, levels = (F.split(F.lit(",".join(map(str, x))), ",").cast("array<int>")
                                               for x in (self.feature, self.left, self.right, self.roots, range(self.depth)))
        value = F.split(F.lit(",".join(map(repr, self.value))), ",").cast("array<double>")

        def step(node: Column, _: Column) -> Column:
            at = F.get(feature, node)
            return F.when(at < 0, node).when(F.get(f, at) <= F.get(value, node), F.get(left, node)).otherwise(F.get(right, node))

        def tree(total: Column, root: Column) -> Column:
            return total + F.get(value, F.aggregate(levels, root, step))

        return F.aggregate(roots, F.lit(0.0), tree) / len(self.roots)


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Forest:
    """Fit the forest on labelled findings (text, source, value, label)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    d = _split(findings, "value", "label").withColumnRenamed("value", "secret")
    d = d.select("secret", "label", F.explode(candidates(F.col("words"), F.col("source"))).alias("c"))
    # other candidates in the text of a secret are left out, not taken for negatives
    d = d.where("not label or c.value = secret").select(F.col("label").cast("double").alias("label"), features(F.col("c")).alias("f"))
    d = d.select("label", array_to_vector("f").alias("features")).cache()
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt",
                                   minInstancesPerNode=2, subsamplingRate=0.8).fit(d)
    d.unpersist()
    return Forest([t.toDebugString for t in model.trees])


_TRAINED: list[Forest] = []    # the forest of the default table, whose rows depend on nothing but its seed


def default_forest(spark: SparkSession) -> Forest:
    """The forest trained on ``labelled_findings``, once a driver."""
    if not _TRAINED:
        _TRAINED.append(train(labelled_findings(spark)))
    return _TRAINED[0]


def _findings(df: DataFrame, forest: Forest, threshold: float) -> Column:
    rated = F.transform(candidates(F.col("words"), F.col("source")),
                        lambda c: F.struct(c["word"].alias("word"), c["value"].alias("value"), c["left"].alias("left"), c["at"].alias("at"),
                                           features(c).alias("f")))
    scored = F.transform(rated, lambda c: F.struct(c["word"].alias("word"), c["value"].alias("value"), c["left"].alias("left"), c["at"].alias("at"),
                                                   forest.vote(c["f"]).alias("score")))
    found = F.filter(scored, lambda c: c["score"] >= threshold)
    # a part of a found value is not another finding
    return F.aggregate(found, F.slice(found, 1, 0), lambda out, c: F.when(
        F.exists(out, lambda o: (o["word"] == c["word"]) & F.contains(o["value"], c["value"])), out).otherwise(F.concat(out, F.array(c))))


def scan(docs: DataFrame, forest: Forest | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per finding: doc_id, word (its number in the text), kind, length, secret_sha256, score."""
    forest = forest or default_forest(docs.sparkSession)
    d = _split(docs, "doc_id")
    found = d.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.explode(_findings(d, forest, threshold)).alias("c"))
    kind = F.when(F.col("c.left").rlike("(?i)pass|pwd"), "password").when(F.col("c.left").rlike(KEY_WORD), "token").otherwise("other")
    for name, pattern in KNOWN:
        kind = F.when(F.col("c.value").rlike(pattern), name).otherwise(kind)
    return found.select("doc_id", F.col("c.word").cast("bigint").alias("word"), kind.alias("kind"),
                        F.length("c.value").cast("bigint").alias("length"), F.sha2("c.value", 256).alias("secret_sha256"),
                        F.col("c.score").alias("score"))


def redact(docs: DataFrame, forest: Forest | None = None, threshold: float = THRESHOLD, mark: str = "[SECRET]") -> DataFrame:
    """The rows with every found secret replaced in ``text`` (null stays null); other columns as they are, n_chars recounted."""
    forest = forest or default_forest(docs.sparkSession)
    cols = docs.columns
    own = [f"_c{i}" for i in range(len(cols))]                 # names that clash with none used here
    old = dict(zip(cols, own))
    d = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in old.items()])
    d = _split(d.withColumns({"text": F.col(old["text"]), "source": F.col(old["source"])}), *own)
    d = d.select(*own, "text", F.explode(F.array(_findings(d, forest, threshold))).alias("_found"))
    # longest first; each in its own word, and values of 8 or more signs wherever else they stand
    by_length = F.transform("_found", lambda c: F.struct((-F.length(c["value"])).alias("n"), c["word"].alias("word"), c["value"].alias("value"), c["at"].alias("at")))
    d = d.select(*own, "text", F.explode(F.array(F.array_sort(by_length))).alias("_found"))
    spaces, words = F.split("text", WORD), F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    word = F.transform(words, lambda w, i: F.aggregate(F.filter("_found", lambda c: c["word"] == i), w, lambda t, c: F.replace(
        t, F.concat(c["at"], c["value"]), F.concat(c["at"], F.lit(mark)))))
    own_words = F.concat(F.array_join(F.transform(F.arrays_zip(F.slice(spaces, F.lit(1), F.size(words)).alias("s"), word.alias("w")),
                                                  lambda z: F.concat(z["s"], z["w"])), ""), F.element_at(spaces, -1))
    clean = F.when(F.exists("_found", lambda c: c["n"] > -8), own_words).otherwise(F.col("text"))
    clean = F.aggregate(F.filter("_found", lambda c: c["n"] <= -8), clean, lambda t, c: F.replace(t, c["value"], F.lit(mark)))
    d = d.select(*own, F.when(F.col(old["text"]).isNotNull(), clean).alias("_clean"))
    new = {"text": F.col("_clean")}
    if "n_chars" in cols:
        new["n_chars"] = F.when(F.col("_clean") == F.col(old["text"]), F.col(old["n_chars"])).otherwise(
            F.length("_clean").cast(docs.schema["n_chars"].dataType))
    return d.select(*[new.get(c, F.col(o)).alias(c) for c, o in old.items()])
