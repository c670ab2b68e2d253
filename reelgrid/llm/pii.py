"""Personal data and secrets by weak supervision, in DataFrame functions only.

Patterns propose spans: strict ones, whose valid matches always stand (the base), and loose
ones: other ways to write the base's kinds (spelled-out addresses, IPv6, national phone
numbers), secrets, IBANs, names and postal addresses. Four labelers vote on each span: its
pattern (does it pass the kind's check), a gazetteer (of domains, country codes, card
prefixes, networks, given names, street words), its context (words before it that speak for
or against, in four languages) and its shape (quoted or assigned, or glued to other
text). Expectation-maximisation over the counts of vote patterns estimates each
labeler's reliability per kind without any true label. Its posteriors then train a logistic
span classifier on the spans' own features; loose spans that it accepts, that the words
before them do not deny, and that touch no base span, are added. Of added spans that overlap, directly or over others, the first stays.

The text is read once; from then on only spans move. Counts of vote and feature patterns,
of which there is a fixed number, come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.llm.scratch import Scratch

#: The base's kinds, then those that only the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "iban", "name", "address")

# Gazetteers.
DOMAIN_ENDS = "com net org edu gov io co info biz eu de fr es uk us ca it nl ch at be pl ru jp cn in br au"
COUNTRY_CODES = r"^\+?(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-9][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[7-9][0-9]|8[0578][0-9]|9[679][0-9])"
CARD_PREFIXES = r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6[0-9])"
PUBLIC_NETWORKS = r"^(?!0\.|127\.|22[4-9]\.|2[345][0-9]\.)"
IBAN_COUNTRIES = "AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SA SE SI SK SM TR"
GIVEN_NAMES = (
    "Alice Amelia Andrew Barbara Benjamin Brian Carlos Catherine Charles Charlotte Christian Christopher Claudia Daniel David Deborah Diego Dorothy Edward Elizabeth Emily Emma Fernando Florian Frank "
    "François Françoise Gabriel George Gerhard Hannah Harold Heinrich Helmut Isabella Jack Jacob Jacques James Javier Jean Jennifer Jessica Jonathan Jorge José Joseph Joshua Juan Jürgen Karen Karl Katharina "
    "Kevin Klaus Laura Linda Lucas Luis Manuel Margaret Maria María Marie Mark Martin Mary Matthew Michael Michel Miguel Nancy Nicolas Olivia Pablo Patricia Patrick Paul Pedro Peter Philippe Pierre Rachel Ricardo "
    "Richard Robert Roberto Ronald Samuel Sandra Sarah Sofia Sophie Stefan Stephen Susan Thomas Ursula Victoria William Wolfgang"
)
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Señor Señora Sr Sra"
STREETS = "Street Avenue Road Lane Drive Boulevard Square Terrace Crescent"

_CAPITAL = r"\p{Lu}\p{Ll}++"
# Strict patterns, with possessive parts where giving back could not help: a long run of
# letters or digits is read once and needs no stack.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SECRET_WORDS = r"password|passwd|pwd|passphrase|passwort|contraseña|mot de passe|secret|token|api[_-]?key|access[_-]?key|private[_-]?key"
#: How keys of well-known services begin.
KNOWN_KEYS = r"^(?:sk|pk|ghp|gho|xox[bap]|AKIA|eyJ)[A-Za-z0-9_+/-]{12,}"
#: (kind, pattern); more than one for a kind.
LOOSE = (
    ("email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?(?:\[at\]|\(at\)|\{at\}) ?[a-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)|\{dot\}) ?[a-z0-9-]++)++"),
    ("email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ at [a-z0-9-]++(?: dot [a-z0-9-]++)++"),
    ("ip", r"(?i)(?<![0-9a-z:.])(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}:){1,6}(?::[0-9a-f]{1,4}){1,6})(?![0-9a-z:]|\.[0-9])"),
    ("card", r"(?<![0-9./_])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9]|[./_][0-9])"),
    ("phone", r"(?<![0-9+()./-])(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9]|[.-][0-9])"),
    ("secret", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+={0,2}"),
    ("secret", rf"(?i)(?<=\b(?:{SECRET_WORDS})[\"']?[ ]?[:=][ ]?[\"']?)[^\s\"',;<>:=]{{6,}}+"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("name", rf"(?<!\p{{L}})(?=\p{{Lu}})(?:(?:{TITLES.replace(' ', '|')})\.? {_CAPITAL}(?:[ -]{_CAPITAL})?|(?:{GIVEN_NAMES.replace(' ', '|')}) (?:\p{{Lu}}\. )?{_CAPITAL}(?:-{_CAPITAL})?)"),
    ("address", rf"(?<![\p{{L}}0-9])[0-9]{{1,5}} (?:{_CAPITAL} ){{1,3}}(?:{STREETS.replace(' ', '|')})(?!\p{{L}})"),
    ("address", r"(?<!\p{L})\p{Lu}\p{Ll}+(?:straße|strasse|weg|platz|allee) [0-9]{1,4}[a-z]?(?![\p{L}0-9])"),
    ("address", rf"(?<![\p{{L}}0-9])(?:[0-9]{{1,4}},? (?:rue|avenue|boulevard|place|chemin) (?:de la |de |du |des )?{_CAPITAL}|(?:Calle|Avenida|Plaza) (?:de la |de |del )?{_CAPITAL},? [0-9]{{1,4}}(?![0-9]))"),
)
#: Patterns by number: (kind, strict, pattern, hint). A text without a match of the hint has none of the pattern either; cheaper to look for.
_HINTS = (
    "@", r"[0-9]\.[0-9]", r"[0-9][\x20-]?[0-9]", "+", r"(?i)[\[({]at[\])}]", r"(?i) dot ", r"(?i)[0-9a-f]:[0-9a-f]{0,4}:[0-9a-f]", r"[0-9]{4}[./_][0-9]{4}", r"[0-9]\)?[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3}",
    r"[0-9][A-Za-z+/_-]|[A-Za-z+/_-][0-9]", r"(?i)(?:pass|pwd|secret|token|key|contrase)[a-zñ _-]{0,8}[\"']? ?[:=]", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", r"\p{Lu}\p{Ll}+\.? \p{Lu}", rf"(?:{STREETS.replace(' ', '|')})",
    r"(?:straße|strasse|weg|platz|allee) [0-9]", r"(?:rue|avenue|boulevard|place|chemin|Calle|Avenida|Plaza) ",
)
PATTERNS = tuple((k, strict, p, hint) for (k, strict, p), hint in zip([*((k, True, p) for k, p in STRICT.items()), *((k, False, p) for k, p in LOOSE)], _HINTS, strict=True))
IP_PARTS = r"^0*(?:1?[0-9]{1,2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:1?[0-9]{1,2}|2[0-4][0-9]|25[0-5])){3}$"

#: Words before a span that speak for its kind, and against it.
FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel|kontakt|an|to|from)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|addr|from|client|serveur|servidor|adresse)\b",
    "card": r"(?i)\b(?:card|credit|visa|mastercard|amex|carte|tarjeta|karte|pay|paid|kreditkarte)\b",
    "phone": r"(?i)\b(?:phone|tel|call|fax|mobile|cell|telefon|telefono|appelez|anruf|dial|whatsapp)\b",
    "secret": rf"(?i)\b(?:{SECRET_WORDS}|key|auth|authorization|bearer|credential|credentials|clave|schlüssel|clé)\b",
    "iban": r"(?i)\b(?:iban|account|konto|compte|cuenta|bank|banque|banco|transfer|überweisung)\b",
    "name": r"(?i)\b(?:name|dear|contact|signed|by|von|from|nom|nombre|llamo|heiße|appelle|sincerely|regards|hello|hi|liebe|lieber|cher|chère|estimado|estimada)\b",
    "address": r"(?i)\b(?:address|live|lives|at|adresse|dirección|wohnt|habite|vive|street|visit|office)\b",
}
_NUMBERS = r"(?i)\b(?:version|isbn|issn|order|invoice|serial|password|token|hash|sha|id|ref|build|release|page|chapter|number|no|nr|part|sku|doi)[\s:=#.]*$"
AGAINST = {k: _NUMBERS for k in BASE_KINDS} | {
    "secret": r"(?i)(?:\b(?:commit|sha|sha-?1|sha-?256|md5|hash|digest|checksum|uuid|guid|isbn|doi|revision|version)\b[\s:=#.\"']*|https?://\S*)$",
    "iban": r"(?i)\b(?:serial|part|sku|model|version)[\s:=#.]*$", "name": r"(?i)\b(?:the|der|die|das|le|la|les|el|los|saint|st|lake|mount|mont|monte)[\s.]*$", "address": r"(?i)\b(?:page|chapter|no|nr|version)[\s:=#.]*$",
}
CONTEXT = 40

ROUNDS = 300
STEPS = 400


def _positions(text: Column, number: int) -> Column:
    """Array of (pattern, kind, strict, i, gap, before, after, match) of a pattern; gap is the length of the text between this and the previous match."""
    kind, strict, pattern, hint = PATTERNS[number]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.split(text, pattern, -1)
    both = F.arrays_zip(F.slice(parts, 1, F.size(found)).alias("p"), F.slice(parts, 2, F.size(found)).alias("q"), found.alias("m"))
    out = F.transform(both, lambda x, i: F.struct(
        F.lit(number).alias("pattern"), F.lit(kind).alias("kind"), F.lit(strict).alias("strict"), i.alias("i"), F.length(x["p"]).alias("gap"),
        F.right(x["p"], F.lit(CONTEXT)).alias("before"), F.left(x["q"], F.lit(1)).alias("after"), x["m"].alias("match"),
    ))
    there = F.contains(text, F.lit(hint)) if len(hint) == 1 else F.rlike(text, F.lit(hint))
    return F.when(there, out)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    at = F.sequence(F.lit(1), n)
    value = F.transform(at, lambda i: F.substr(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(value, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _digits() -> Column:
    return F.regexp_replace("match", "[^0-9]", "")


def _iban_rest() -> Column:
    """Remainder of an IBAN modulo 97: its first four characters go last, letters count from 10."""
    plain = F.replace("match", F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))

    def step(a: Column, c: Column) -> Column:
        digit = F.ascii(c) - F.when(F.ascii(c) >= 65, 55).otherwise(48)
        return (a * F.when(digit >= 10, 100).otherwise(10) + digit) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)


def _valid() -> Column:
    """Whether a match passes its kind's check."""
    n = F.length(_digits())
    mixed = F.length("match").between(20, 200) & F.rlike("match", F.lit("[a-z]")) & F.rlike("match", F.lit("[A-Z]")) & (n >= 3)
    return (
        F.when(F.col("kind") == "ip", F.when(F.contains("match", F.lit(":")), True).otherwise(F.rlike("match", F.lit(IP_PARTS))))
        .when(F.col("kind") == "card", F.when(n.between(12, 19), _luhn(_digits())).otherwise(False))
        .when(F.col("kind") == "phone", n.between(9, 15))
        .when(F.col("kind") == "secret", F.rlike("match", F.lit(r"^(?i)(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$")) | F.rlike("match", F.lit(KNOWN_KEYS)) | mixed)
        .when(F.col("kind") == "iban", F.length(F.replace("match", F.lit(" "), F.lit(""))).between(15, 34) & (_iban_rest() == 1)).otherwise(True)
    )


def _by_kind(cases: dict[str, Column]) -> Column:
    out = F.lit(None)
    for kind, value in cases.items():
        out = F.when(F.col("kind") == kind, value).otherwise(out)
    return out


def _votes() -> dict[str, Column]:
    """1 for, -1 against, 0 no opinion."""
    end = F.lower(F.regexp_extract("match", r"([A-Za-z0-9-]+)$", 1))
    characters = F.size(F.array_distinct(F.split(F.lower("match"), "")))
    gazetteer = _by_kind({
        "email": F.when(end.isin(*DOMAIN_ENDS.split()), 1).otherwise(-1),
        "ip": F.when(F.rlike("match", F.lit(PUBLIC_NETWORKS)), 1).otherwise(-1),
        "card": F.when(F.rlike(_digits(), F.lit(CARD_PREFIXES)), 1).otherwise(-1),
        "phone": F.when(F.startswith("match", F.lit("+")), F.when(F.rlike("match", F.lit(COUNTRY_CODES)), 1).otherwise(-1)).otherwise(0),
        "secret": F.when(characters <= 5, -1).otherwise(0),
        "iban": F.when(F.left("match", F.lit(2)).isin(*IBAN_COUNTRIES.split()), 1).otherwise(-1),
        "name": F.when(F.rlike("match", F.lit(rf"\b(?:{GIVEN_NAMES.replace(' ', '|')}) ")), 1).otherwise(0),
        "address": F.when(F.rlike("match", F.lit(r"[0-9]")), 1).otherwise(-1),
    })
    speaks = _by_kind({k: F.rlike("before", F.lit(v)) for k, v in FOR.items()})
    denies = _by_kind({k: F.rlike("before", F.lit(v)) for k, v in AGAINST.items()})
    titled = F.rlike("match", F.lit(rf"^(?:{TITLES.replace(' ', '|')})\b"))
    checked = _by_kind({"iban": F.when(_valid(), 1).otherwise(-1), "secret": F.rlike("match", F.lit(KNOWN_KEYS)).cast("int"), "name": titled.cast("int")})
    given = F.rlike("before", F.lit(r"(?:[=:]\s?|[=:]?\s?[\"'`(<\[])$"))
    alone = ~F.rlike("before", F.lit(r"[\p{L}\p{N}=\"':/_-]$")) & ~F.rlike("after", F.lit(r"^[\p{L}\p{N}=/_-]"))
    return {
        "v_pattern": F.when(F.col("base"), 1).when(F.col("strict"), -1).otherwise(F.coalesce(checked, F.lit(0))),
        "v_gazetteer": gazetteer,
        "v_context": F.when(denies, -1).when(speaks, 1).otherwise(0),
        "v_shape": F.when(given, 1).when(alone, 0).otherwise(-1),
    }


def _features() -> dict[str, Column]:
    n = F.length(_digits())
    return {
        "f_valid": _valid().cast("int"), "f_strict": F.col("strict").cast("int"),
        "f_long": F.when(n > 10, 1).otherwise(0), "f_marked": F.rlike("match", F.lit(r"[@+(\[{]")).cast("int"),
        "f_split": F.rlike("match", F.lit(r"[0-9][\x20()./_-]+[0-9]")).cast("int"),
        "f_alone": (~F.rlike("before", F.lit(r"[\p{L}\p{N}=\"':/_-]$")) & ~F.rlike("after", F.lit(r"^[\p{L}\p{N}=/_-]"))).cast("int"),
        "f_given": F.rlike("before", F.lit(r"(?:[=:]\s?|[=:]?\s?[\"'`(<\[])$")).cast("int"),
        "f_spoken": (F.col("v_context") == 1).cast("int"), "f_denied": (F.col("v_context") == -1).cast("int"), "f_listed": (F.col("v_gazetteer") == 1).cast("int"),
        "f_letters": F.rlike("match", F.lit(r"\p{L}")).cast("int"),
    }


FEATURES = ("f_valid", "f_strict", "f_long", "f_marked", "f_split", "f_alone", "f_given", "f_spoken", "f_denied", "f_listed", "f_letters")
VOTES = ("v_pattern", "v_gazetteer", "v_context", "v_shape")


def reliabilities(counts: dict[tuple[int, ...], int]) -> tuple[float, list[dict[int, tuple[float, float]]], dict[tuple[int, ...], float]]:
    """Dawid-Skene expectation-maximisation over vote patterns -> share of true spans, for each labeler P(vote | true), P(vote | false), posteriors."""
    post = {v: 1 / (1 + exp(-1.5 * sum(v))) for v in counts}
    share, tables = 0.5, []
    for _ in range(ROUNDS):
        true = sum(post[v] * n for v, n in counts.items())
        whole = sum(counts.values())
        share = min(0.999, max(0.001, (true + 1) / (whole + 2)))
        tables = []
        for k in range(len(next(iter(counts)))):
            table = {}
            for vote in (-1, 0, 1):
                # a labeler is taken to be better than chance to begin with
                yes = sum(post[v] * n for v, n in counts.items() if v[k] == vote) + (2 if vote == 1 else 1)
                no = sum((1 - post[v]) * n for v, n in counts.items() if v[k] == vote) + (2 if vote == -1 else 1)
                table[vote] = (yes / (true + 4), no / (whole - true + 4))
            tables.append(table)
        for v in counts:
            odds = log(share / (1 - share)) + sum(log(t[x][0] / t[x][1]) for t, x in zip(tables, v, strict=True))
            post[v] = 1 / (1 + exp(-max(-30.0, min(30.0, odds))))
    return share, tables, post


def fit_classifier(cells: list[tuple[tuple[int, ...], float, int]]) -> list[float]:
    """Logistic regression on (features, probability, count) by gradient steps; the bias is first."""
    if not cells:
        return []
    w = [0.0] * (len(cells[0][0]) + 1)
    whole = sum(n for _, _, n in cells)
    for _ in range(STEPS):
        grad = [0.002 * x for x in w]
        for f, p, n in cells:
            z = w[0] + sum(a * b for a, b in zip(w[1:], f, strict=True))
            off = (1 / (1 + exp(-max(-30.0, min(30.0, z)))) - p) * n / whole
            grad[0] += off
            for i, x in enumerate(f):
                grad[i + 1] += off * x
        w = [a - 2.0 * g for a, g in zip(w, grad, strict=True)]
    return w


@dataclass(frozen=True)
class SpanModel:
    weights: dict[str, list[float]]  # by kind

    def accepts(self) -> Column:
        out = F.lit(False)
        for kind, w in self.weights.items():
            z = F.lit(w[0])
            for name, x in zip(FEATURES, w[1:], strict=True):
                z = z + F.col(name) * F.lit(x)
            out = F.when(F.col("kind") == kind, z > 0).otherwise(out)
        return out


def train_spans(spans: DataFrame) -> SpanModel:
    """spans with kind, VOTES and FEATURES. A count for each of their combinations comes to the driver: a number that does not grow with the documents."""
    rows = spans.groupBy("kind", *VOTES, *FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()
    weights = {}
    for kind in KINDS:
        mine = [r for r in rows if r["kind"] == kind]
        counts: dict[tuple[int, ...], int] = {}
        for r in mine:
            votes = tuple(r[v] for v in VOTES)
            counts[votes] = counts.get(votes, 0) + r["n"]
        if counts:
            _, _, post = reliabilities(counts)
            weights[kind] = fit_classifier([(tuple(r[f] for f in FEATURES), post[tuple(r[v] for v in VOTES)], r["n"]) for r in mine])
    return SpanModel(weights)


def find_spans(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Written rows (uid, id, thash) of all documents, and all spans that stand: uid, kind, kind_no, start, end, base, match."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = "array<struct<pattern:int,kind:string,strict:boolean,i:int,gap:int,before:string,after:string,match:string>>"
    hits = [F.coalesce(_positions(F.col("t"), k).cast(none), F.array().cast(none)) for k in range(len(PATTERNS))]
    read = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.xxhash64(text).alias("thash"), text.alias("t"))
    seen = scratch.put(read.select("uid", "id", "thash", F.concat(*hits).alias("hits")), "seen")
    rows = seen.select("uid", F.explode("hits").alias("h")).select("uid", "h.*")
    before = Window.partitionBy("uid", "pattern").orderBy("i")
    length = F.length("match")
    placed = rows.withColumn("end", F.sum(F.col("gap") + length).over(before)).withColumn("start", F.col("end") - length)
    placed = placed.withColumn("base", F.col("strict") & _valid()).drop("gap", "i")
    # a loose span, or a strict one that failed, stands back where it touches a base span
    by_start = Window.partitionBy("uid").orderBy("start", F.desc("base"))
    held = F.max(F.when(F.col("base"), F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    coming = F.min(F.when(F.col("base"), F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    free = F.coalesce(held <= F.col("start"), F.lit(True)) & F.coalesce(coming >= F.col("end"), F.lit(True))
    candidates = scratch.put(placed.withColumn("free", free).where("base or free").withColumns(_votes()).withColumns(_features()), "candidates")
    model = train_spans(candidates)
    number = _by_kind({k: F.lit(i) for i, k in enumerate(KINDS)})
    undenied = (F.col("v_context") >= 0) | (F.col("v_pattern") > 0)  # what the words before it deny is added only where it passes a check
    stands = candidates.where(F.col("base") | (model.accepts() & undenied)).withColumn("kind_no", number)
    earlier = Window.partitionBy("uid").orderBy("start", "kind_no", F.desc("end"), "pattern").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.max(F.when(~F.col("base"), F.col("end"))).over(earlier) > F.col("start")
    stands = stands.withColumn("covered", ~F.col("base") & F.coalesce(covered, F.lit(False))).where("not covered")
    return seen.select("uid", "id", "thash"), stands.select("uid", "kind", "kind_no", "start", "end", "base", "match")


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, thash (a hash of its text) and `found`, its spans (start, kind_no, end, kind, base, match) in order.

    Null text: empty. Positions are code points, the end exclusive. Added spans never touch
    base spans. Repeated rows come out once each; an empty table gives no rows; other
    columns are not read. Whole texts count.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    rows, spans = find_spans(docs, scratch, id_col, text_col)
    lists = spans.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "kind_no", "end", "kind", "base", "match"))).alias("found"))
    kind = "array<struct<start:bigint,kind_no:int,end:bigint,kind:string,base:boolean,match:string>>"
    return rows.join(lists, "uid", "left").select(F.col("id").alias(id_col), "thash", F.coalesce(F.col("found").cast(kind), F.array().cast(kind)).alias("found"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, all spans as text, n_spans of them, and n_secret."""
    base = F.filter("found", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        id_col, *map(count, BASE_KINDS), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"),
        F.size("found").cast("long").alias("n_spans"), F.size(F.filter("found", lambda s: s["kind"] == "secret")).cast("long").alias("n_secret"),
    )


def masked(found: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every found span replaced by its kind in square brackets; null texts stay null.

    Spans are those of the same id and text, so ids may repeat; a row without any in `found`
    stays as it is. Of base spans that overlap, the one that begins first gives the name.
    """
    spans = found.select(F.col(id_col).alias("found_id"), F.col("thash").alias("found_hash"), "found").groupBy("found_id", "found_hash").agg(F.first("found").alias("found"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    mine = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("own_id"), F.xxhash64(text).alias("own_hash"), text.alias("t"))
    ends = F.transform("found", lambda s: s["end"])

    def piece(s: Column, i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.array_max(F.slice(ends, F.lit(1), i))).cast("int")
        name = F.concat(F.lit("["), s["kind"], F.lit("]"))
        return F.when(s["start"] < begin, F.lit("")).otherwise(F.concat(F.substr(F.col("t"), begin + 1, (s["start"] - begin).cast("int")), name))

    out = F.concat(F.concat_ws("", F.transform("found", piece)), F.substr(F.col("t"), F.coalesce(F.array_max(ends), F.lit(0)).cast("int") + 1))
    joined = mine.join(spans, F.col("own_id").eqNullSafe(F.col("found_id")) & (F.col("own_hash") == F.col("found_hash")), "left")
    changed = F.when(F.size("found") > 0, out).otherwise(F.col(f"doc.{text_col}"))
    return joined.select(F.col("doc").withField(text_col, changed).alias("doc")).select("doc.*")
