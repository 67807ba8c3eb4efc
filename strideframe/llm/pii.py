"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Base patterns (e-mail, IP address, card, phone) give spans that always stay. Looser patterns
propose more spans: secrets, phones and e-mails in other spellings, names after titles. On every
proposed span regex, gazetteer and context labelers vote yes, no or abstain. Spark counts how
often each combination of votes and coarse features occurs over the whole corpus; expectation
maximisation (two classes, one sensitivity and specificity for each labeler) estimates the
labelers' reliabilities from these counts; a logistic span classifier is trained on the resulting
posteriors; and a second pass over the texts keeps the proposals that it accepts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm._common import column, fresh, text_rows

#: Kinds in the order in which spans of one start are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "name")

# --- base patterns -----------------------------------------------------------------------------

#: Scanned from each "@" to both sides, so that long runs of word characters cost no more than their length.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin at the first digit of a run; possessive runs fail at once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start, then kind."""
    out = []
    at = text.find("@")
    end = 0
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((start, end, "email"))
        at = text.find("@", max(at + 1, end))
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], BASE_KINDS.index(s[2])))


# --- proposals and votes -----------------------------------------------------------------------

_SECRET = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+(?![A-Za-z0-9_/+-])={0,2}")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{4}(?![0-9.-])")
_SPELT_EMAIL = re.compile(r"[A-Za-z0-9._-]{1,64}\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z]{2,24}")
_TITLED = re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.?\x20[^\W\d_]{2,40}(?:\x20[^\W\d_]{2,40})?")
#: Words that stand before personal data.
CONTEXT = {
    "email": ("mail", "contact", "write to", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "móvil"),
    "secret": ("token", "secret", "password", "passwd", "api_key", "apikey", "api key", "key", "auth", "bearer"),
    "name": ("dear", "by", "signed", "contact", "from", "regards"),
}
#: Common given names and mail providers.
GIVEN_NAMES = frozenset(
    """
    adam adele adrian agnes alain alan albert alejandro alex alexander alice alina amanda amelia amy ana andrea andreas andrew angela anita anna anne antoine antonio
    barbara beatriz ben benjamin bernard bernd birgit brian brigitte camille carla carlos carmen caroline catherine charles charlotte chloe christian christine claire clara claudia
    daniel david deborah diana diego dieter dominique donald edward elena elisabeth elizabeth emily emma enrique eric erik ernesto eva felix fernando francisco frank franz
    gabriel george gerard gisela grace gregory guillermo hannah hans heinz helen helena henri henry ines irene isabel jacques jakob james jan jane javier jean jennifer jessica joan joao
    john jonas jorge jose joseph juan julia julie julien karen karl katharina kevin klaus laura lea lena linda lisa louis louise lucas lucia luis luisa manuel marc maria marie mark marta
    martin mary matthew max mia michael michel miguel monika nicolas nina olivia oscar patricia paul peter philippe pierre rachel raul rebecca richard robert rosa sandra sarah sebastian
    simon sofia sophie stefan stephen susan sylvie teresa thomas ursula victor walter wolfgang
    """.split()
)
MAIL_HOSTS = ("example", "gmail", "outlook", "hotmail", "yahoo", "proton", "icloud", "gmx", "web.de", "orange", "laposte", "libero", "yandex", "zoho", "fastmail", "aol", "live.", "t-online", "mail")
#: Text of samples and placeholders.
PLACEHOLDERS = ("xxxx", "0000000", "1234567", "placeholder", "changeme", "your_")
LABELERS = ("shape", "gazetteer", "context", "quoted", "mixture", "placeholder")
YES, NO, ABSTAIN = 1, 0, 2


def proposals(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of the looser patterns that overlap no base span nor each other."""
    found = []
    if _DIGITS.search(text):
        found += [(m.start(), m.end(), "secret") for m in _SECRET.finditer(text) if _DIGITS.search(m[0]) and not m[0].isdigit()]
        found += [(m.start(), m.end(), "phone") for m in _LOCAL_PHONE.finditer(text)]
    if "dot" in text:
        found += [(m.start(), m.end(), "email") for m in _SPELT_EMAIL.finditer(text)]
    if any(t in text for t in ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Sr")):
        found += [(m.start(), m.end(), "name") for m in _TITLED.finditer(text) if m[0].split(" ", 1)[1][0].isupper()]
    out, end, taken = [], 0, sorted((s, e) for s, e, _ in base)
    i = 0
    for s, e, kind in sorted(found, key=lambda x: (x[0], -x[1], KINDS.index(x[2]))):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if s >= end and not (i < len(taken) and taken[i][0] < e):
            out.append((s, e, kind))
            end = e
    return out


def churn(span: str) -> float:
    """How often, of all neighbours, lower-case letters, upper-case letters and digits take turns; marks don't count."""
    kinds = [0 if c.islower() else 1 if c.isupper() else 2 for c in span if c.isalnum()]
    return sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, len(kinds) - 1)


def votes(text: str, start: int, end: int, kind: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Votes of the labelers on a span, and its coarse features."""
    span, low = text[start:end], text[start:end].lower()
    before = text[max(0, start - 40) : start].lower()
    digits = sum(c.isdigit() for c in span)
    share = digits / max(1, len(span))
    if kind == "secret":
        mixed = span != low and span != span.upper()
        # Paths and lists of words have slashes too, but letters of one case stand together there.
        wordy = ("/" in span or "+" in span) and churn(span) < 0.35
        shape = NO if wordy else YES if re.fullmatch(r"[0-9a-f]{32,}", low) or (mixed and "-" not in span and len(span) >= 24) else NO if span.count("-") >= 2 else ABSTAIN
        named = YES if re.match(r"(?:sk|pk|ghp|xox|akia)", low) else ABSTAIN
        mixture = YES if 0.15 <= share <= 0.85 and "-" not in span.strip("-") and not wordy else NO
    elif kind == "name":
        shape = YES if all(p[:1].isupper() for p in span.split()[1:]) else NO
        named = YES if any(p in GIVEN_NAMES for p in low.split()[1:]) else ABSTAIN
        mixture = ABSTAIN
    elif kind == "email":
        shape, named = YES, YES if any(h in low for h in MAIL_HOSTS) else ABSTAIN
        mixture = ABSTAIN
    else:
        shape = YES if kind != "phone" or 7 <= digits <= 15 else NO
        named = YES if span.startswith("+") else ABSTAIN
        mixture = YES if digits >= 7 else NO
    context = YES if any(c in before for c in CONTEXT[kind]) else ABSTAIN
    quoted = YES if before[-1:] in ('"', "'", "=", ":", "<", "(") and text[end : end + 1] in ('"', "'", ">", ")", "", "\n", ",", ";", " ") else ABSTAIN
    bad = NO if any(p in low for p in PLACEHOLDERS) or len(set(low)) <= 3 else ABSTAIN
    feats = (KINDS.index(kind), min(4, len(span) // 10), min(3, int(share * 4)), int(context == YES), int(quoted == YES))
    return (shape, named, context, quoted, mixture, bad), feats


# --- the model ---------------------------------------------------------------------------------


def _code(vote: tuple[int, ...], feats: tuple[int, ...]) -> int:
    out = 0
    for v in vote:
        out = out * 3 + v
    for f in feats:
        out = out * 8 + f
    return out


def _decode(code: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    feats, vote = [], []
    for _ in range(5):
        code, f = divmod(code, 8)
        feats.append(f)
    for _ in LABELERS:
        code, v = divmod(code, 3)
        vote.append(v)
    return tuple(reversed(vote)), tuple(reversed(feats))


@dataclass
class SpanModel:
    """Labeler reliabilities and classifier weights; ``accepts`` maps each combination to a decision."""

    sensitivity: np.ndarray = field(default_factory=lambda: np.full(len(LABELERS), 0.8))
    specificity: np.ndarray = field(default_factory=lambda: np.full(len(LABELERS), 0.8))
    weights: np.ndarray | None = None

    def probability(self, code: int) -> float:
        if self.weights is None:
            return 0.0
        return float(1 / (1 + np.exp(-_design([code])[0] @ self.weights)))


def _design(codes: list[int]) -> np.ndarray:
    rows = []
    for code in codes:
        vote, feats = _decode(code)
        row = [1.0]
        for v in vote:
            row += [float(v == YES), float(v == NO)]
        row += [float(feats[0] == i) for i in range(len(KINDS))]
        row += [feats[1] / 4, feats[2] / 3, float(feats[3]), float(feats[4])]
        rows.append(row)
    return np.array(rows)


def fit_spans(counts: dict[int, int], rounds: int = 50) -> SpanModel:
    """EM over vote combinations and their counts, then logistic regression on the posteriors.

    ``counts`` has one entry for each combination of votes and features, so its size is bounded by
    the combinations there are, whatever the corpus.
    """
    model = SpanModel()
    codes = sorted(counts)
    if not codes:
        return model
    n = np.array([counts[c] for c in codes], float)
    vote = np.array([_decode(c)[0] for c in codes])
    yes, no = (vote == YES).astype(float), (vote == NO).astype(float)
    prior = 0.5
    for _ in range(rounds):
        sens, spec = model.sensitivity, model.specificity
        log_1 = np.log(prior) + yes @ np.log(sens) + no @ np.log(1 - sens)
        log_0 = np.log(1 - prior) + yes @ np.log(1 - spec) + no @ np.log(spec)
        post = 1 / (1 + np.exp(np.clip(log_0 - log_1, -50, 50)))
        # Pseudo-counts keep a labeler that rarely votes near its prior of 0.8.
        true, false = n * post, n * (1 - post)
        model.sensitivity = (true @ yes + 8) / (true @ (yes + no) + 10)
        model.specificity = (false @ no + 8) / (false @ (yes + no) + 10)
        prior = float(np.clip((true.sum() + 1) / (n.sum() + 2), 0.02, 0.98))
    x = _design(codes)
    w = np.zeros(x.shape[1])
    scaled = n / n.sum()
    for _ in range(50):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (scaled * (p - post)) + 1e-3 * w
        hess = (x * (scaled * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    model.weights = w
    return model


# --- over Spark --------------------------------------------------------------------------------


def vote_counts(docs: DataFrame, text_col: str = "text") -> dict[int, int]:
    """How often each combination of votes and features occurs on base and proposed spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py() or ""
                base = base_spans(text)
                for span in (*base, *proposals(text, base)):
                    code = _code(*votes(text, *span))
                    seen[code] = seen.get(code, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["code", "n"])

    rows = text_rows(docs, text_col).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return {r.code: r.n for r in rows.collect()}


def _accepted(texts: pa.Array, model: SpanModel, threshold: float) -> Iterator[list[tuple[int, int, str, bool]]]:
    """The spans of each text as (start, end, kind, base), by start, then kind."""
    accepted: dict[int, bool] = {}
    for text in texts:
        text = text.as_py() or ""
        base = base_spans(text)
        rows = [(*s, True) for s in base]
        for s in proposals(text, base):
            code = _code(*votes(text, *s))
            if code not in accepted:
                accepted[code] = model.probability(code) >= threshold
            if accepted[code]:
                rows.append((*s, False))
        rows.sort(key=lambda r: (r[0], KINDS.index(r[2]), r[1]))
        yield rows


def find_pii(docs: DataFrame, text_col: str = "text", spans_col: str = "spans", threshold: float = 0.5, model: SpanModel | None = None) -> DataFrame:
    """``docs`` with ``spans_col``: array of (start, end, kind, base) by start, then kind.

    Offsets are code points, ends exclusive; spans have any length. ``base`` tells base spans from those that the method
    added. Without a ``model`` one is fitted on the vote counts of all of ``docs``.

    Null and empty texts have no spans. A corpus without any proposals leaves the model unfitted,
    which accepts none. Null ids, repeated rows and ties pass through, one row for each row. Texts
    of any length are scanned whole. An empty table gives an empty result. Extra columns pass
    through; a column named like ``spans_col`` is replaced.
    """
    model = model or fit_spans(vote_counts(docs, text_col))

    @F.arrow_udf("array<struct<start:int,end:int,kind:string,base:boolean>>")
    def spans(texts: pa.Array) -> pa.Array:
        out = [[{"start": a, "end": b, "kind": k, "base": own} for a, b, k, own in rows] for rows in _accepted(texts, model, threshold)]
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())])))

    return docs.withColumn(spans_col, spans(column(text_col).cast("string")))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every found span in ``text_col`` replaced by its kind in brackets.

    Overlapping spans are replaced together by the kind of the first. Null texts stay null; the
    other cases are those of ``find_pii``.
    """
    model = fit_spans(vote_counts(docs, text_col))

    # Spans are found and replaced in one function: with one on top of the other each task has two Python workers.
    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts.to_pylist(), _accepted(texts, model, 0.5), strict=True):
            if own:
                parts, end = [], 0
                for start, stop, kind, _ in own:
                    if start >= end:
                        parts += [text[end:start], f"[{kind.upper()}]"]
                    end = max(end, stop)
                text = "".join([*parts, text[end:]])
            out.append(text)
        return pa.array(out, pa.string())

    text = masked(column(text_col).cast("string"))
    return docs.select(*[text.alias(c) if c == text_col else column(c) for c in docs.columns])
