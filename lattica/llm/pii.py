"""Personal data and secrets replaced by keyed surrogates of the same type and form.

Detected: e-mail addresses, phone numbers, IPv4 addresses, payment cards, IBANs, US social security
numbers, API keys, tokens and passwords after a label, and personal names with a title: Latin (to U+00FF),
Cyrillic and Greek ones after it, Chinese ones (a usual surname and up to two characters) before it.  Names without
a title are not found.

A surrogate is drawn by HMAC-SHA-256 from (secret, type, canonical entity, attempt): letters stay
letters of their script and case, digits stay digits, separators stay in place; cards keep a valid check
digit, addresses end in reserved domains, Latin names keep the title's gender.  The same entity gets the
same surrogate everywhere (coreference).  Surrogates of all distinct entities are compared: where two
entities draw one surrogate, or a surrogate equals a real entity, all but the first draw again
with the next attempt until none collide (distinctness).
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.storage import Scratch, bounded_batches

#: Titles that tell a gender (m, f) or none (n), in the languages of the corpus.
TITLES = {"Mr": "m", "Sir": "m", "Herr": "m", "Señor": "m", "Sr": "m", "Monsieur": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Señora": "f", "Sra": "f", "Madame": "f", "Mme": "f", "Dr": "n", "Prof": "n"}
TITLES |= {"Господин": "m", "господин": "m", "Г-н": "m", "г-н": "m", "Госпожа": "f", "госпожа": "f", "Г-жа": "f", "г-жа": "f", "Доктор": "n", "доктор": "n", "Д-р": "n", "д-р": "n", "Профессор": "n", "профессор": "n", "Проф": "n", "проф": "n"}
TITLES |= {"Κύριος": "m", "κύριος": "m", "Κύριο": "m", "κύριο": "m", "Κύριε": "m", "κύριε": "m", "Κυρία": "f", "κυρία": "f", "Δρ": "n", "δρ": "n", "Καθηγητής": "m", "καθηγητής": "m", "Καθηγήτρια": "f", "καθηγήτρια": "f"}
#: Titles that follow a Chinese name, and the surnames that start one.
HAN_TITLES = {"先生": "m", "女士": "f", "小姐": "f", "太太": "f", "博士": "n", "教授": "n"}
HAN_SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严武戴莫孔向汤張劉陳楊黃趙吳孫馬羅鄭謝許韓馮鄧蕭蔣葉蘇呂盧鍾譚陸賈韋鄒閻龍賀顧龔萬錢嚴湯"
_NAME_WORD = "(?:[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+|[А-ЯЁЄІЇЎҐ][а-яёєіїўґ]+|[Α-ΩΆΈ-ΊΌΎΏ][α-ωά-ίόύώΐΰϊϋ]+)"
#: Word parts from which names are made, and endings by gender.
SYLLABLES = ("ba", "del", "fi", "gor", "ha", "ki", "lem", "mo", "nar", "pe", "ro", "sa", "tul", "ve", "wi", "zan")
ENDINGS = {"m": ("o", "us", "er", "on"), "f": ("a", "ia", "ine", "elle"), "n": ("is", "en", "al", "or")}
#: Attempts in an entity's own form before longer surrogates are drawn.
SAME_FORM = 32

PATTERNS = {
    "email": r"(?<![\w.+%-])[\w.+%-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "aws_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "api_key": r"\b(?:sk|pk|ghp|gho|xox[abp])[-_][A-Za-z0-9_-]{16,}",
    "secret": r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b[\"']?\s*[:=]\s*)[\"']?(?P<secret>[^\s\"',;]{6,})",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?![\w-])|(?<![\w.])\+\d{8,15}(?!\w)",
    "name": r"\b(?P<title>" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")\b\.? (?P<name>" + _NAME_WORD + "(?:[ -]" + _NAME_WORD + ")*)|(?P<han>[" + HAN_SURNAMES + "][一-鿿]{0,2}?)(?P<after>" + "|".join(HAN_TITLES) + ")",
}
_ALL = re.compile("|".join(f"(?P<k_{k}>{p})" for k, p in PATTERNS.items()))
#: A text without any of these holds no entity: every pattern needs one of them.
_HINT = re.compile(r"[@\d]|AKIA|ASIA|" + "|".join([*TITLES, *HAN_TITLES]) + r"|[-_=:]")
_SPAN = "kind string, entity string, start int, stop int, gender string"


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(x) for x in reversed(digits)))
    return total % 10 == 0


def find_entities(text: str | None) -> list[tuple[str, str, int, int, str]]:
    """(kind, entity as written, start, stop, gender) of each entity, from left to right, none within another."""
    if not text or not _HINT.search(text):
        return []
    out = []
    for m in _ALL.finditer(text):
        kind = next(k[2:] for k in m.groupdict() if k.startswith("k_") and m.group(k) is not None)
        gender, (start, stop) = "n", m.span()
        if kind in ("secret", "name"):
            start, stop = m.span("han" if m["han"] else kind)
        if kind == "name":
            gender = HAN_TITLES[m["after"]] if m["han"] else TITLES[m["title"]]
        value = text[start:stop]
        if kind == "card" and not luhn(re.sub(r"\D", "", value)) and len(re.sub(r"\D", "", value)) not in (15, 16):
            continue
        out.append((kind, value, start, stop, gender))
    return out


def canonical(kind: str, value: str) -> str:
    """What two writings of one entity have in common."""
    if kind == "email":
        return value.lower()
    if kind in ("phone", "card", "ssn"):
        return re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    return value


def _stream(secret: bytes, *parts: str) -> Iterator[int]:
    """Random bytes that only the secret and the parts determine."""
    message, n = "\x1f".join(parts).encode("utf-8", "surrogatepass"), 0
    while True:
        yield from hmac.digest(secret, message + n.to_bytes(4, "big"), "sha256")
        n += 1


def _below(stream: Iterator[int], n: int) -> int:
    return int.from_bytes(bytes(next(stream) for _ in range(6))) % n


def _letters(c: str) -> str:
    """The alphabet of a letter's script, in its case."""
    for first, last, of in (("а", "я", "Ѐӿ"), ("α", "ω", "ͰϿ")):
        low = "".join(map(chr, range(ord(first), ord(last) + 1))).replace("ς", "")
        if of[0] <= c <= of[1]:
            return low.upper() if c.isupper() else low
    if "一" <= c <= "鿿":
        return "".join(map(chr, range(0x4E00, 0x4E00 + 2000)))
    low = "abcdefghijklmnopqrstuvwxyz"
    return low.upper() if c.isupper() else low


def _same_form(value: str, stream: Iterator[int], hexa: bool = False) -> str:
    out = []
    for c in value:
        if c.isdigit():
            out.append(str(_below(stream, 10)))
        elif c.isalpha():
            letters = _letters(c)
            if hexa:
                letters = letters[:6]
            out.append(letters[_below(stream, len(letters))])
        else:
            out.append(c)
    return "".join(out)


def surrogate(secret: bytes, kind: str, entity: str, gender: str, attempt: int) -> str:
    """The replacement of a canonical entity, in canonical form.

    The space of surrogates grows with the attempt, so that there is a free one for every entity: names get a
    syllable or letter more each time, e-mail domains a wider number, IP addresses a second reserved range.  What keeps
    an entity's form is drawn ``SAME_FORM`` times in it (once, if it has no letter or digit), then with
    a digit more each time; IP addresses then come from IPv6's range for documentation.
    """
    s = _stream(secret, kind, entity, gender if kind == "name" else "", str(attempt))
    if kind == "email":
        return _same_form(entity.split("@")[0], s) + f"@mail{_below(s, 10_000 * 16 ** min(attempt, 8))}.example.org"
    if kind == "ip":
        if attempt >= SAME_FORM:
            return "2001:db8:" + ":".join(f"{_below(s, 65536):x}" for _ in range(6))
        first = "10" if attempt < 4 else str(240 + _below(s, 15))
        return first + "." + ".".join(str(_below(s, 256)) for _ in range(3))
    if kind != "name":
        changes = any(c.isdigit() or c.isalpha() for c in entity)
        more = "0" * max(0, attempt + 1 - SAME_FORM if changes else attempt)
        entity = entity[:-1] + more + entity[-1] if kind == "card" else entity + more
    if kind in ("phone", "ssn"):
        return _same_form(entity, s)
    if kind == "card":
        body = _same_form(entity[:-1], s)
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))
    if kind == "iban":
        return entity[:2] + _same_form(entity[2:], s)
    if kind == "aws_key":
        return entity[:4] + _same_form(entity[4:], s)
    if kind == "name":
        words = re.split(r"([ -])", entity)
        made = [w if w in " -" else "".join(SYLLABLES[_below(s, 16)] for _ in range(2 + _below(s, 2) + attempt)).capitalize() for w in words]
        made[0] += ENDINGS[gender][_below(s, 4)]  # the first word shows the gender
        first = entity[0]
        if not "A" <= first <= "ɏ":
            return _same_form(entity + entity[-1] * attempt, s)
        return "".join(made)
    return _same_form(entity, s, hexa=bool(re.fullmatch(r"[0-9a-f]+", entity)))


def written_like(kind: str, value: str, replacement: str) -> str:
    """A canonical replacement in the writing of ``value``: its separators stay."""
    if kind in ("phone", "card", "ssn", "iban"):
        rest = iter(replacement)
        return "".join(next(rest) if c.isalnum() else c for c in value) + "".join(rest)
    return replacement


def distinct_surrogates(entities: DataFrame, secret: bytes, scratch: Scratch) -> DataFrame:
    """(kind, entity, gender, replacement), no two entities of a kind alike and no replacement a real entity."""
    bounded_batches(entities.sparkSession)
    base = scratch.write(entities.groupBy("kind", "entity").agg(F.min("gender").alias("gender")), "entities")

    def draw(attempt: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                kind, entity, gender = (b.column(i).to_pylist() for i in range(3))
                made = [surrogate(secret, *x, attempt) for x in zip(kind, entity, gender, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(made, pa.string())], ["kind", "entity", "gender", "replacement"])

        return run

    left, settled, attempt = base, None, 0
    real = base.select("kind", F.col("entity").alias("replacement"))
    while True:
        drawn = left.mapInArrow(draw(attempt), "kind string, entity string, gender string, replacement string")
        drawn = scratch.write(drawn, "drawn")
        first = drawn.groupBy("kind", "replacement").agg(F.min("entity").alias("entity"))
        fine = first.join(real, ["kind", "replacement"], "left_anti")
        if settled is not None:
            fine = fine.join(settled, ["kind", "replacement"], "left_anti")
        good = scratch.write(drawn.join(fine, ["kind", "replacement", "entity"], "left_semi").select("kind", "entity", "gender", "replacement"), "good")
        settled = good if settled is None else settled.union(good)
        left = scratch.write(drawn.join(good, ["kind", "entity"], "left_anti").select("kind", "entity", "gender"), "again")
        if left.isEmpty():
            return settled
        attempt += 1


def replace_entities(docs: DataFrame, secret: bytes, text: str = "text", keep: tuple[str, ...] = ("doc_id",), listed: int = 100_000) -> DataFrame:
    """``keep`` columns, ``text`` with surrogates, ``n_entities`` (long) and ``spans`` (kind, start, stop in the result).

    Null texts stay null with no entities; texts without entities are unchanged; repeated rows are treated
    alike; an empty table gives an empty result.

    The first draw follows from the entity alone, so texts need not be joined with the list of entities: only
    entities whose first draw collided need their later one.  Those few are handed to the tasks when
    they number ``listed`` at most; beyond that they are joined to the texts that hold them.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "pii")

    def entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {(k, canonical(k, v), g) for t in b.column(0).to_pylist() for k, v, _, _, g in find_entities(t)}
            cols = list(zip(*sorted(found), strict=True)) if found else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["kind", "entity", "gender"])

    seen = scratch.write(docs.select(docs[text]).mapInArrow(entities, "kind string, entity string, gender string").distinct(), "seen")
    table = scratch.write(distinct_surrogates(seen, secret, scratch), "surrogates")

    def first_draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, entity, gender, made = (c.to_pylist() for c in b.columns)
            yield b.filter(pa.array([surrogate(secret, k, e, g, 0) != m for k, e, g, m in zip(kind, entity, gender, made, strict=True)], pa.bool_()))

    # a name that stands with several titles is drawn with the least gender, which its text does not tell
    mixed = seen.where("kind = 'name'").groupBy("kind", "entity").agg(F.count_distinct("gender").alias("n")).where("n > 1").select("kind", "entity")
    odd = table.mapInArrow(first_draw, table.schema).select("kind", "entity", "replacement")
    odd = scratch.write(odd.union(table.join(mixed, ["kind", "entity"], "left_semi").select("kind", "entity", "replacement")).distinct(), "odd")

    names = [*keep, text, "n_entities", "spans"]
    kept = docs.select(*[docs[c] for c in keep], docs[text].alias(text))
    schema = ", ".join([f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep] + [f"`{text}` string", "n_entities long", "spans array<struct<kind:string,start:int,stop:int>>"])
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def rewrite(t: str | None, known: dict) -> tuple[str | None, list[dict]]:
        if t is None:
            return None, []
        out, at, spans, size = [], 0, [], 0
        for kind, value, start, stop, gender in find_entities(t):
            entity = canonical(kind, value)
            made = known.get((kind, entity)) or surrogate(secret, kind, entity, gender, 0)
            made = written_like(kind, value, made)
            out += [t[at:start], made]
            size += start - at
            spans.append({"kind": kind, "start": size, "stop": size + len(made)})
            size, at = size + len(made), stop
        return "".join(out) + t[at:], spans

    width = len(keep)

    def result(b: pa.RecordBatch, texts: list, known: list[dict]) -> pa.RecordBatch:
        done = [rewrite(t, k) for t, k in zip(texts, known, strict=True)]
        return pa.RecordBatch.from_arrays([*b.columns[:width], pa.array([x[0] for x in done], pa.string()), pa.array([len(x[1]) for x in done], pa.int64()), pa.array([x[1] for x in done], span_type)], names)

    if odd.count() <= listed:
        known = {(r["kind"], r["entity"]): r["replacement"] for r in odd.collect()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield result(b, b.column(width).to_pylist(), [known] * b.num_rows)

        return kept.mapInArrow(run, schema)

    # texts are numbered once, in a written table, and only those with such an entity meet the list
    numbered = scratch.write(kept.withColumn("_row", F.monotonically_increasing_id()), "numbered")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(r, *x) for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in {(k, canonical(k, v)) for k, v, _, _, _ in find_entities(t)}]
            cols = list(zip(*found, strict=True)) if found else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()), strict=True)], ["_row", "kind", "entity"])

    need = numbered.select("_row", text).mapInArrow(held, "_row long, kind string, entity string").join(odd, ["kind", "entity"])
    need = need.groupBy("_row").agg(F.collect_list(F.struct("kind", "entity", "replacement")).alias("_known"))

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = [{(x["kind"], x["entity"]): x["replacement"] for x in (k or [])} for k in b.column(width + 1).to_pylist()]
            yield result(b, b.column(width).to_pylist(), known)

    return numbered.join(need, "_row", "left").select(*keep, text, "_known").mapInArrow(run_joined, schema)


def key_of(passphrase: str) -> bytes:
    return hashlib.sha256(passphrase.encode()).digest()
