"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs the labelers,
and a classifier trained on its verdicts decides.

Candidates are what the base patterns find, which always stays, and other spellings: addresses
spelled out, IPv6, numbers with other separators, local telephone numbers, and secrets (long keys
of mixed letters and digits), which stay only if the classifier says so.

DataFrame functions only; the driver sees counts of vote patterns, at most 3 ** 5 for each kind.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formwork.llm.common import written

KINDS = ("email", "ip", "card", "phone", "secret")
LABELERS = ("shape", "gazetteer", "check", "context", "edge")

# Java patterns.  Those of the base kinds find what the plain patterns of the contract find,
# leftmost first, without trying each place inside a run that has already failed:
# email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
# ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
# card   [0-9]([\x20-]?[0-9])+ of 13 to 19 digits
# phone  \+[0-9][\x20().0-9-]+[0-9]
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text needs to be searched at all: each match of a pattern holds a match of its hint, so
#: that no span depends on what else the text has.
HINT = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Other spellings, which only count if the classifier says so.  What begins like a path is no secret.
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++(?: ?[(\[{]at[)\]}] ?| at )[a-z0-9-]++(?:(?: ?[(\[{]dot[)\]}] ?| dot )[a-z0-9-]++)++",
    "ip": r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:])",
    "card": r"(?<![0-9._/])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9._/])",
    "phone": r"(?<![0-9A-Za-z+.(-])(?<!\+[0-9]{1,3} )(?:\([0-9]{2,5}\) ?|0[0-9]{1,4}[ ./-]|[0-9]{3}[.-])[0-9]{3,4}[ .-][0-9]{3,5}(?![0-9A-Za-z.-])",
    "secret": r"(?<![A-Za-z0-9_+/=.-])(?!(?:[A-Za-z]{2,}+/){2})(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{20,}+={0,2}(?![A-Za-z0-9_+/=.-])",
}
LOOSE_HINT = {"email": r"(?i)[(\[{ ]dot[)\]} ]", "ip": r"(?i)[0-9a-f]:[0-9a-f]{1,4}:", "card": r"[0-9]{4}[._/][0-9]{4}[._/][0-9]{4}", "phone": r"[0-9](?:\) ?|[ ./-])[0-9]{3,4}[ .-][0-9]{3}", "secret": r"[A-Za-z0-9_+/-]{20}"}

#: Gazetteers (fixed values): top-level domains, calling codes, first digits of card issuers.
DOMAINS = r"(?i)[.\]) ](?:com|org|net|edu|gov|int|mil|info|io|co|de|fr|es|it|nl|be|at|ch|uk|us|eu|ca|au|jp|cn|br|mx|ar|pt|pl|se|no|dk|fi|example|test)$"
CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1368]|35[1-9]|37[0-9]|38[0-9]|42[01]|[2-9][0-9]{2})|^\(|^0"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[4-9]|6)"
SECRETS = r"^(?:sk|pk|rk|gh[opsu]|xox[abps]|glpat|AKIA|ASIA|AIza|ya29|eyJ|npm|hf|dop_v1)[-_A-Z0-9a-z]"
#: Words before a span (fixed values), in the four languages of the tables and in general use.
FRIENDS = {
    "email": r"(?i)(?:mail|contact|kontakt|correo|courriel|schreib|write|escrib)[^\n]{0,16}$",
    "ip": r"(?i)(?:\bip\b|address|adresse|direcci|server|serveur|servidor|host)[^\n]{0,16}$",
    "card": r"(?i)(?:card|karte|carte|tarjeta|visa|mastercard|amex|credit|kredit)[^\n]{0,16}$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobil|handy|móvil|ruf|appel|llam)[^\n]{0,16}$",
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|bearer|credential|auth)[\"' ]{0,2}(?:[:=]|is)?[\"' ]{0,3}$",
}
NO_SECRETS = r"(?i)(?:sha(?:1|256|512)?|md5|commit|revision|checksum|digest|etag|https?:|file|path|isbn|version|build)[^\n]{0,12}$"
STRANGERS = r"(?i)(?:version|release|v\.|isbn|issn|token|secret|key|hash|serial|sku|section|\bart\.|§)[^\n]{0,12}$"

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(gaps: Column, hits: Column, block: int = 64) -> Column:
    """``hits`` as (match, start, before, after): each begins where the gaps and hits before it end.

    Sums of whole blocks keep the cost of the running sums low in texts with very many hits."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    lengths = F.transform(hits, lambda h, i: F.length(h) + F.length(F.get(gaps, i)))

    def from_lengths(n: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / block).cast("int")), lambda b: total(F.slice(n, b * block + 1, F.lit(block))))

        def from_blocks(sums: Column) -> Column:
            def one(h: Column, i: Column) -> Column:
                b = F.floor(i / block).cast("int")
                ended = total(F.slice(sums, F.lit(1), b)) + total(F.slice(n, b * block + 1, i - b * block + 1))
                return F.struct(h.alias("match"), (ended - F.length(h)).alias("start"), F.right(F.get(gaps, i), F.lit(40)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(2)).alias("after"))

            return F.transform(hits, one)

        return _let(blocks, from_blocks)

    return _let(lengths, from_lengths)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0)).cast("byte")


def _votes(kind: str, loose: bool, hit: Column) -> Column:
    """The candidate with the labelers' votes: 1 for personal data, -1 against, 0 abstains."""
    match, before, after = hit["match"], hit["before"], hit["after"]
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    never = F.lit(False)
    if kind == "email":
        valid = F.lit(True)
        known, unknown = match.rlike(DOMAINS), ~match.rlike(DOMAINS)
        good = ~match.contains("..") & (F.length(match) <= 254)
        wrong = ~good
    elif kind == "ip":
        valid = F.lit(True) if loose else match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
        known = match.rlike(r"^(?:10|127|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168)\.") | match.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.") | match.rlike(r"(?i)^(?:2[0-9a-f]{3}|fe80|f[cd][0-9a-f]{2}):")
        unknown = ~known
        good, wrong = valid & ~match.rlike(r"(?:^|\.)0[0-9]"), ~valid
    elif kind == "card":
        valid = n.between(13, 19) & F.call_function("luhn_check", digits)
        known, unknown = digits.rlike(ISSUERS), ~digits.rlike(ISSUERS)
        good, wrong = F.call_function("luhn_check", digits), ~F.call_function("luhn_check", digits)
    elif kind == "phone":
        valid = n.between(9, 15)
        known, unknown = match.rlike(CODES), ~match.rlike(CODES)
        good, wrong = n.between(9, 15), ~n.between(9, 15)
    else:  # Random keys mix their letters and digits; names and paths have words.
        valid = never
        letters = F.length(F.regexp_replace(match, "[^A-Za-z]", ""))
        known, unknown = match.rlike(SECRETS), match.rlike(r"[a-z]{7}|[A-Z]{9}|(?:[A-Za-z]{3,}[/_-]){2}")
        good = (n * 10 >= F.length(match)) & (letters * 10 >= F.length(match)) & (F.size(F.array_distinct(F.split(match, ""))) >= 10)
        wrong = ~good
    base = never if loose else valid
    shape = _vote(base, never if loose else ~valid)
    glued = before.rlike(r"[\p{L}\p{N}_=/]$") | after.rlike(r"^(?:[\p{L}\p{N}_=/]|\.[0-9])")
    context = _vote(before.rlike(FRIENDS[kind]), before.rlike(NO_SECRETS if kind == "secret" else STRANGERS))
    if kind == "secret":
        shape = _vote(match.rlike(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$") | (match.rlike("[a-z]") & match.rlike("[A-Z]") & good), match.rlike(r"^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$|/"))
        glued = ~(before.rlike(r"[\"'`= ]$") & after.rlike(r"^(?:[\"'`\s.,;)]|$)"))
    names = (shape, _vote(known, unknown), _vote(good, wrong), context, _vote(~glued, glued))
    return F.struct(
        F.lit(KINDS.index(kind)).cast("byte").alias("kind"),
        hit["start"].alias("start"),
        (hit["start"] + F.length(match)).alias("end"),
        F.coalesce(base, F.lit(False)).alias("base"),
        *(v.alias(name) for v, name in zip(names, LABELERS)),
    )


def candidates(text: Column) -> Column:
    """All candidate spans of a text, by kind, base spellings first, with votes."""
    found = []
    for kind in KINDS:
        for loose, patterns, hints in ((False, BASE, HINT), (True, LOOSE, LOOSE_HINT)):
            if kind not in patterns:
                continue
            pattern = F.lit(patterns[kind])
            hits = F.regexp_extract_all(text, pattern, F.lit(0))
            gaps = F.split(text, patterns[kind], -1)
            placed = _let(F.struct(gaps.alias("gaps"), hits.alias("hits")), lambda x: _starts(x["gaps"], x["hits"]))
            voted = F.transform(placed, partial(_votes, kind, loose))
            found.append(F.when(text.rlike(hints[kind]), voted))
    empty = F.filter(F.array(_votes("email", False, F.struct(F.lit("").alias("match"), F.lit(0).alias("start"), F.lit("").alias("before"), F.lit("").alias("after")))), lambda x: F.lit(False))
    return F.concat(*(F.coalesce(x, empty) for x in found))


@dataclass(frozen=True)
class SpanModel:
    """P(span is personal data) = logistic(bias + weight of each vote cast), by kind."""

    bias: tuple[float, ...]
    weights: tuple[tuple[tuple[float, float], ...], ...]  # by kind and labeler: of a vote against, of one for

    def probability(self, candidate: Column) -> Column:
        of_kind = lambda values: F.element_at(F.array(*map(F.lit, values)), candidate["kind"] + 1)
        z = of_kind(self.bias)
        for j, name in enumerate(LABELERS):
            against, for_it = ([w[j][side] for w in self.weights] for side in (0, 1))
            z = z + F.when(candidate[name] > 0, of_kind(for_it)).when(candidate[name] < 0, of_kind(against)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


#: How often each labeler's votes are taken to be right before any are counted, by kind.
EXPECTED = {
    "email": (0.95, 0.8, 0.8, 0.8, 0.7),
    "ip": (0.95, 0.7, 0.9, 0.8, 0.8),
    "card": (0.95, 0.8, 0.95, 0.8, 0.7),
    "phone": (0.95, 0.7, 0.6, 0.9, 0.6),
    "secret": (0.6, 0.8, 0.6, 0.95, 0.6),
}


def estimate(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 60, imagined: float = 20.0) -> list[float]:
    """For (kind, votes, count) rows the probability of personal data, by expectation-maximisation
    of the labelers' reliabilities (how often each votes for a span, of either class) and the
    kinds' shares, kind by kind.  Abstaining says nothing.

    ``imagined`` votes by ``EXPECTED`` begin each labeler's counts: they say which class is which."""
    posterior = [0.5] * len(patterns)
    for kind in {k for k, _, _ in patterns}:
        rows = [i for i, (k, _, _) in enumerate(patterns) if k == kind]
        votes = np.array([patterns[i][1] for i in rows])
        n = np.array([patterns[i][2] for i in rows], float)
        first = np.array(EXPECTED[KINDS[kind]])
        true, false, share = first, 1 - first, 0.5  # P(vote for | class), where a vote is cast
        for _ in range(rounds):
            log = np.where(votes > 0, np.log(true / false), np.where(votes < 0, np.log((1 - true) / (1 - false)), 0.0))
            p = 1 / (1 + np.exp(-np.clip(math.log(share / (1 - share)) + log.sum(axis=1), -500, 500)))
            share = (2 + (p * n).sum()) / (4 + n.sum())
            true, false = ((imagined * at + (w * (votes > 0).T).sum(axis=1)) / (imagined + (w * (votes != 0).T).sum(axis=1)) for w, at in ((p * n, first), ((1 - p) * n, 1 - first)))
        for i, x in zip(rows, p.tolist()):
            posterior[i] = x
    return posterior


def train(patterns: list[tuple[int, tuple[int, ...], int]], posterior: list[float], ridge: float = 0.3) -> SpanModel:
    """Logistic regression of the posteriors on the votes, kind by kind, by Newton's steps.

    Counts enter by their logarithm, so that a pattern with a million spans doesn't silence the
    rest.  A kind without candidates keeps its base spans alone."""
    bias, weights = [], []
    for kind in range(len(KINDS)):
        rows = [i for i, (k, _, _) in enumerate(patterns) if k == kind]
        x = np.zeros((len(rows), 1 + 2 * len(LABELERS)))
        x[:, 0] = 1
        for r, i in enumerate(rows):
            for j, v in enumerate(patterns[i][1]):
                if v:
                    x[r, 1 + 2 * j + (v > 0)] = 1
        y, n = np.array([posterior[i] for i in rows]), np.log2(1 + np.array([patterns[i][2] for i in rows], float))
        w = np.zeros(x.shape[1])
        for _ in range(30 if rows else 0):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
            w += np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (y - p)) - ridge * w)
        bias.append(float(w[0]) if rows else -10.0)
        weights.append(tuple((float(a), float(b)) for a, b in w[1:].reshape(-1, 2)))
    return SpanModel(tuple(bias), tuple(weights))


def fit(found: DataFrame) -> SpanModel:
    """The model for a table with a column ``candidates``, learned from all of its rows."""
    votes = found.select(F.explode("candidates").alias("c")).groupBy("c.kind", *(f"c.{name}" for name in LABELERS)).agg(F.count("*").alias("n"))
    rows = sorted((r.kind, tuple(r[name] for name in LABELERS), r.n) for r in votes.collect())
    return train(rows, estimate(rows))


def decide(found: Column, model: SpanModel, threshold: float = 0.5) -> Column:
    """The spans of ``candidates``: base spans, and those that the model wants and that overlap no
    base span; ``array<struct<kind, start, end, base, probability>>``, by kind, then start."""
    base = F.filter(found, lambda c: c["base"])
    others = F.filter(found, lambda c: ~c["base"] & (model.probability(c) >= threshold))
    apart = _let(base, lambda b: F.filter(others, lambda c: ~F.exists(b, lambda x: (x["start"] < c["end"]) & (c["start"] < x["end"]))))
    named = F.transform(F.concat(base, apart), lambda c: F.struct(c["kind"].alias("rank"), c["start"].alias("start"), c["end"].alias("end"), F.element_at(F.array(*map(F.lit, KINDS)), c["kind"] + 1).alias("kind"), c["base"].alias("base"), model.probability(c).alias("probability")))
    return F.transform(F.sort_array(named), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), c["probability"].alias("probability")))


def find(docs: DataFrame, threshold: float = 0.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, spans``: the personal data of each text (offsets in code points, end exclusive).

    Regex, gazetteer, checksum, context and edge labelers vote on candidates; expectation-
    maximisation over the counts of all documents' vote patterns gives their reliabilities, and the
    classifier trained on its posteriors decides.  Spans of the base patterns always stay.

    Null and empty texts have no spans, whole texts count, repeated rows stay, and an empty table
    gives no rows.  Other columns are ignored.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    found = written(docs.select(F.col(id_column).alias("doc_id"), candidates(text).alias("candidates")))
    return found.select("doc_id", decide(F.col("candidates"), fit(found), threshold).alias("spans"))


def redact(docs: DataFrame, threshold: float = 0.5, text_column: str = "text") -> DataFrame:
    """``docs`` with each span in the text replaced by its kind in angle brackets.

    Overlapping spans are replaced together, by the kind of the first.  A null text stays null;
    columns keep their names and order, whatever they are.  The candidates are written once."""
    held = written(docs.select(F.struct("*").alias("row"), candidates(F.coalesce(F.col(text_column), F.lit(""))).alias("candidates")))
    text = F.col("row")[text_column]

    def step(done: Column, s: Column) -> Column:
        fresh = s["start"] >= done["at"]
        piece = F.concat(F.substring(text, done["at"] + 1, s["start"] - done["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        pieces = F.when(fresh, F.concat(done["pieces"], F.array(piece))).otherwise(done["pieces"])
        return F.struct(pieces.alias("pieces"), F.greatest(done["at"], s["end"]).alias("at"))

    begin = F.struct(F.array().cast("array<string>").alias("pieces"), F.lit(0).alias("at"))
    order = F.sort_array(F.transform(F.col("spans"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    new = F.aggregate(order, begin, step, lambda done: F.concat(F.array_join(done["pieces"], ""), F.substring(text, done["at"] + 1, F.length(text))))
    rows = held.select("row", decide(F.col("candidates"), fit(held), threshold).alias("spans"))
    kept = [F.when(F.size("spans") > 0, new).otherwise(text).alias(c) if c == text_column else F.col("row")[c].alias(c) for c in docs.columns]
    return rows.select(*kept)
