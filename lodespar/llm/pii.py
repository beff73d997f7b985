"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespar.llm.common import cut, in_arrow, text_hash, texts, unit_hash

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "secret", "ssn")

# The base patterns, each as one that scans in linear time. A digit run can't be entered in its middle.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Candidates beside the base ones.
_MORE = (
    ("email", re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]++\s?(?:\(at\)|\[at\]|\{at\}|\sat\s)\s?[A-Za-z0-9-]++(?:\s?(?:\(dot\)|\[dot\]|\{dot\}|\sdot\s)\s?[A-Za-z0-9-]{2,}+)++(?!\w)", re.I)),
    ("phone", re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+.-])00[1-9][0-9]{0,2}[ .-](?:\(?[0-9]{2,4}\)?[ .-]){1,3}[0-9]{3,4}(?![\w-])")),
    ("ssn", re.compile(r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("secret", re.compile(r"(?<![0-9A-Za-z_-])[0-9A-Za-z_-]{20,}+")),
)
# Gazetteers (top-level domains, calling codes, first digits of card issuers, countries of account numbers) and context words.
_TLD = frozenset("com org net edu gov int info biz io co uk de fr es it nl ch at be eu us ca au jp cn in br mx pl se no dk fi pt ie ru za nz example invalid test".split())
_CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 354 358 370 371 372 380 420 421 852 886 971 972".split())
_ISSUER = frozenset("23456")
_IBAN = frozenset("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split())
_CUES = {
    "email": "email e-mail mail contact write reply correo courriel",
    "ip": "ip address host server client login from adresse",
    "card": "card visa mastercard amex credit debit payment carte karte tarjeta pan",
    "phone": "phone tel telephone call mobile cell fax telefon teléfono téléphone contact",
    "iban": "iban account bank konto cuenta compte",
    "secret": "token secret password passwd api key apikey auth bearer credential",
    "ssn": "ssn social security number",
}
_AGAINST = frozenset("version isbn issn doi page chapter section sha md5 commit build serial order invoice figure table licence license".split())
_CUE_WORDS = {k: frozenset(v.split()) for k, v in _CUES.items()}
_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping matches of the email pattern, each character looked at once."""
    done, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        a = at
        while m and a > done and text[a - 1] in _LOCAL:
            a -= 1
        if m and a < at:
            yield a, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            done = max(done, at + 1)
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, valid) of every match of the four base patterns, by kind and start."""
    found = [("email", a, b, True) for a, b in _emails(text)]
    found += [("ip", *m.span(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))) for m in _IP.finditer(text)]
    for m in _CARD.finditer(text):
        n = sum(map(str.isdigit, m.group())) if m.end() - m.start() <= 40 else 99
        found.append(("card", *m.span(), 13 <= n <= 19 and luhn("".join(filter(str.isdigit, m.group())))))
    for m in _PHONE.finditer(text) if "+" in text else ():
        found.append(("phone", *m.span(), 9 <= sum(map(str.isdigit, m.group())) <= 15))
    return found


def _iban_valid(value: str) -> bool:
    value = value.replace(" ", "")
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _mixed(value: str) -> bool:
    return any(map(str.isdigit, value)) and any(map(str.isalpha, value))


def candidates(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, str, list[int]]]]:
    """The valid base spans; and further candidates: kind, start, end, votes, features.

    Votes of the labelers, in order: pattern check, gazetteer, context for, context against, isolation; each
    ``+`` (personal data), ``-`` (not) or ``0`` (abstains)."""
    base = [(k, a, b) for k, a, b, ok in base_spans(text) if ok]
    more = [(k, *m.span()) for k, pattern in _MORE if k != "email" or "dot" in text.lower() for m in pattern.finditer(text) if k != "secret" or _mixed(m.group())]
    starts, ends, kept = [], [], []
    for a, b in sorted((a, b) for _, a, b in base):  # what base spans cover, as disjoint ranges
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for k, a, b in sorted(more, key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        at = bisect_left(starts, b) - 1
        if (at < 0 or ends[at] <= a) and (not kept or kept[-1][2] <= a):
            kept.append((k, a, b))
    return base, [(k, a, b, *_votes(text, k, a, b)) for k, a, b in [*base, *kept]]


def _votes(text: str, kind: str, a: int, b: int) -> tuple[str, list[int]]:
    value, before, after = text[a:b], text[max(0, a - 48) : a], text[b : b + 16]
    digits = "".join(filter(str.isdigit, value))
    if kind == "iban":
        check = "+" if _iban_valid(value) else "-"
    elif kind == "ssn":
        check = "+" if digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000" else "-"
    elif kind == "secret":
        bare = value.replace("-", "").replace("_", "")
        check = "+" if len(set(bare.lower())) >= 10 and 0.15 <= len(digits) / len(value) <= 0.85 else "-"
    else:
        check = "+"
    gazetteer = "0"
    if kind == "email":
        gazetteer = "+" if re.split(r"[^A-Za-z0-9-]+|dot", value)[-1].lower() in _TLD else "0"
    elif kind == "phone":
        code = digits[2:] if value.startswith("00") else digits
        gazetteer = "+" if any(code[:n] in _CALLING for n in (1, 2, 3)) and value[0] in "+0" else "0"
    elif kind == "card":
        gazetteer = "+" if digits[0] in _ISSUER else "-"
    elif kind == "iban":
        gazetteer = "+" if value[:2] in _IBAN else "-"
    elif kind == "ip":
        gazetteer = "-" if digits and value.split(".")[0] in ("0", "127", "255") else "+"
    words = [x.lower() for x in _WORDS.findall(before)][-4:]
    context = "+" if any(x in _CUE_WORDS[kind] for x in words) else "0"
    against = "-" if any(x in _AGAINST for x in words) else "0"
    isolated = "+" if (not before or not before[-1].isalnum()) and (not after or not after[0].isalnum()) else "-"
    shape = [KINDS.index(kind), 8 + min(len(value) // 4, 31), 40 + min(10 * len(digits) // len(value), 10)]
    return check + gazetteer + context + against + isolated, shape + [51 + text_hash(x, 1024) for x in words] + [1075 + text_hash(after[:2], 64)]


FEATURES, VOTERS = 1139, 5


@dataclass
class SpanModel:
    weight: np.ndarray  # of the features, then of each labeler's votes for each kind
    bias: float

    def probability(self, kind: str, votes: str, features: list[int]) -> float:
        raw = self.bias + self.weight[features].sum() + self.weight[vote_features(kind, votes)].sum()
        return float(1 / (1 + np.exp(-np.clip(raw, -30, 30))))


def vote_features(kind: str, votes: str) -> list[int]:
    return [FEATURES + (KINDS.index(kind) * VOTERS + j) * 3 + "-0+".index(v) for j, v in enumerate(votes)]


def reliabilities(patterns: list[tuple[str, str, int]], rounds: int = 100) -> dict[tuple[str, str], float]:
    """P(personal data) for each (kind, votes) of ``patterns`` (kind, votes, count), by expectation-maximisation.

    Labelers are independent given the truth. Those of all kinds share what isn't seen often: each table of P(vote |
    truth) starts, and is smoothed, by a labeler that is right more often than not."""
    out: dict[tuple[str, str], float] = {}
    for kind in sorted({k for k, _, _ in patterns}):
        votes = np.array([["-0+".index(c) for c in v] for k, v, _ in patterns if k == kind])
        count = np.array([n for k, _, n in patterns if k == kind], float)
        # of the votes, if it is personal data, and if not: a check of digits or checksums is right more often than the others
        belief = np.array([[[0.05, 0.4, 0.55], [0.55, 0.4, 0.05]], *[[[0.15, 0.4, 0.45], [0.45, 0.4, 0.15]]] * (VOTERS - 1)])
        table, prior = belief.copy(), 0.5
        for _ in range(rounds):
            like = np.stack([np.log(table[np.arange(VOTERS), t][np.arange(VOTERS), votes]).sum(1) for t in (0, 1)], 1) + np.log([prior, 1 - prior])
            p = 1 / (1 + np.exp(np.clip(like[:, 1] - like[:, 0], -500, 500)))
            prior = float(np.clip((p @ count + 2) / (count.sum() + 4), 0.01, 0.99))
            for t, w in ((0, p * count), (1, (1 - p) * count)):
                for j in range(VOTERS):
                    got = np.bincount(votes[:, j], w, 3) + 20 * belief[j, t]
                    table[j, t] = got / got.sum()
        out |= {(kind, v): float(x) for (v,), x in zip(((v,) for k, v, _ in patterns if k == kind), p, strict=True)}
    return out


def fit_spans(rows: list[tuple[str, str, list[int]]], soft: np.ndarray, epochs: int = 200, rate: float = 0.1, decay: float = 1e-3) -> SpanModel:
    """Logistic regression of the soft labels on shape, hashed context and votes, by full-batch Adam."""
    full = [x + vote_features(k, v) for k, v, x in rows]
    row, col = np.repeat(np.arange(len(full)), [len(x) for x in full]), np.array([y for x in full for y in x], np.int64)
    size = FEATURES + len(KINDS) * VOTERS * 3
    w, m, s = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, epochs + 1):
        error = (1 / (1 + np.exp(-np.clip(w[-1] + np.bincount(row, w[col], len(full)), -30, 30))) - soft) / max(1, len(full))
        g = np.append(np.bincount(col, error[row], size) + decay * w[:-1], error.sum())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return SpanModel(w[:-1], float(w[-1]))


SPANS = "array<struct<kind:string,start:long,end:long,votes:string,features:array<int>>>"


def find_personal_data(docs: DataFrame, spans_to_fit: int = 20_000, least: float = 0.5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, added of every row of ``docs`` (doc_id, text).

    Matches of the base patterns that pass their check are always kept; counts and base_sha256 are theirs. Labelers vote
    on them and on further candidates (written-out addresses, numbers without a country code, account
    numbers, secrets). The votes' patterns are counted over all documents, expectation-maximisation makes
    beliefs of them, and a span classifier learns these beliefs from about ``spans_to_fit`` spans chosen by hash.
    Candidates stay at a probability of ``least``, whichever labelers voted for them. ``added``: how many; ``n_spans``: of all.

    ``spans``: kind:start:end of all, comma-joined, by kind (email, ip, card, phone, then by name) and start; code
    points, end exclusive. Null and empty texts have none; repeated rows get equal results; no rows give no rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, digest, spans, more = [], [], [], []
            for text in texts(batch):
                base, voted = candidates(text)
                count.append([sum(k == kind for k, _, _ in base) for kind in BASE])
                said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
                digest.append(hashlib.sha256(said.encode()).hexdigest())
                spans.append(said)
                more.append([{"kind": k, "start": a, "end": b, "votes": v, "features": f} for k, a, b, v, f in voted])
            n = len(digest)
            columns = [pa.array([x[i] for x in count], pa.int64()) for i in range(4)] if n else [pa.array([], pa.int64())] * 4
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(more, kind)], names=["doc_id", *(f"n_{x}" for x in BASE), "base_sha256", "base", "voted"])

    head = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string"
    found = cut(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").transform(in_arrow, scan, f"{head}, base string, voted {SPANS}"))
    each = found.where(F.size("voted") > 0).select("doc_id", "base_sha256", F.explode("voted").alias("s"))
    # at most 3 ** VOTERS patterns of a kind
    patterns = [(x.kind, x.votes, x.n) for x in each.groupBy("s.kind", "s.votes").agg(F.count("*").alias("n")).orderBy("kind", "votes").collect()]
    belief = reliabilities(patterns)
    share = min(1.0, spans_to_fit / max(1, sum(n for _, _, n in patterns)))
    chosen = each.where(unit_hash("doc_id", "base_sha256", "s.kind", "s.start") < share).dropDuplicates(["doc_id", "base_sha256", "s"])
    sample = chosen.select("s.kind", "s.votes", "s.features").orderBy("kind", "votes", "features").collect()
    model = docs.sparkSession.sparkContext.broadcast(fit_spans([(x.kind, x.votes, x.features) for x in sample], np.array([belief[x.kind, x.votes] for x in sample])))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, total, added = [], [], []
            for base, voted in zip(batch.column("base").to_pylist(), batch.column("voted").to_pylist(), strict=True):
                own = base.split(",") if base else []
                kept = [(s["kind"], s["start"], s["end"]) for s in voted[len(own) :] if model.value.probability(s["kind"], s["votes"], s["features"]) >= least]
                split = [x.split(":") for x in own]
                every = sorted([*((k, int(a), int(b)) for k, a, b in split), *kept], key=lambda x: (KINDS.index(x[0]), x[1]))
                spans.append(",".join(f"{k}:{a}:{b}" for k, a, b in every))
                total.append(len(every))
                added.append(len(kept))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(6)), pa.array(spans, pa.string()), pa.array(total, pa.int64()), pa.array(added, pa.int64())], names=[*batch.schema.names[:6], "spans", "n_spans", "added"])

    return found.select(*(x.split()[0] for x in head.split(", ")), "base", "voted").transform(in_arrow, decide, f"{head}, spans string, n_spans long, added long")
