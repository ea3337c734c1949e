"""Text as Column expressions: tokens, n-grams, similarity, ids, coercion and masking."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Token pattern, company suffixes, mask shapes.
TOKEN = r"([0-9A-Za-z]+(?:[-_./][0-9A-Za-z]+)*)"
HAN_RUN = r"([一-鿿]+)"
COMPANY_SUFFIX = "有限责任公司|有限公司|股份|公司"
ADDRESS_MARKS = r"[.,;:!?'\"/\\|()\[\]{}<>、，。；：！？“”‘’（）【】《》\-—_]"
STOP_WORDS = "帮我 请 麻烦 查一下 查询 查查 查 看一下 看 一下 的 是多少 多少 怎么样 如何 是 呢 吗 公司 数据 情况 信息".split()
QUERY_MARKS = r"[，。！？、,.!?;；:：\"'“”‘’()（）\[\]【】\s]+"
FULL_MASK, AMOUNT_MASK = "****", "***,***.00"
_TOKEN, _HAN = re.compile(TOKEN), re.compile(HAN_RUN)
_WIDE, _NARROW = "０１２３４５６７８９", "0123456789"


def windows(text: Column, n: int) -> Column:
    """All substrings of n characters; none of a shorter text. Characters are split once, as a substring by place would scan the text each time."""
    chars = F.split(text, "")
    size = F.greatest(F.size(chars) - (n - 1), F.lit(0))
    part = [F.slice(chars, i + 1, size) for i in range(n)]
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, y)), part)


def tokens(text: Column) -> Column:
    """Search tokens: compound ASCII words in lower case, then Han runs as bigrams (a run of one or two stays whole)."""
    words = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 1), F.lower)
    runs = F.transform(F.regexp_extract_all(text, F.lit(HAN_RUN), 1), lambda r: F.when(F.length(r) <= 2, F.array(r)).otherwise(windows(r, 2)))
    return F.concat(words, F.flatten(runs))


def token_list(text: str) -> list[str]:
    """tokens() of a plain string."""
    words = [w.lower() for w in _TOKEN.findall(text)]
    if not text.isascii():
        for run in _HAN.findall(text):
            words += [run] if len(run) <= 2 else [run[i : i + 2] for i in range(len(run) - 1)]
    return words


@cache
def _alnum() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def bigram_codes(text: str) -> np.ndarray:
    """bigrams() of a plain string as sorted numbers, one for each distinct bigram."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    code = code[_alnum()[code]].astype(np.uint64)
    return np.unique((code[:-1] << np.uint64(21)) | code[1:])


def bigrams(text: Column) -> Column:
    """Distinct lower-case bigrams of letters and digits."""
    return F.array_distinct(windows(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")), 2))


def name_bigrams(text: Column) -> Column:
    """Distinct bigrams with punctuation kept; a single character stands for itself."""
    return F.when(F.length(text) == 1, F.array(text)).otherwise(F.array_distinct(windows(text, 2)))


def coverage(query: Column, text: Column) -> Column:
    """Share of the query's n-grams that the text has; 0 for an empty query."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, text)) / F.size(query)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def hashed_id(kind: str, *parts: Column, digits: int = 16) -> Column:
    return F.concat(F.lit(kind + ":"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, digits))


def nfkc(text: Column) -> Column:
    """Compatibility form of Unicode; no built-in has it."""

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return form(text)


def _bare(text: Column) -> Column:
    return F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), r"[\s\p{Z}]+", "")


def without_suffix(name: Column) -> Column:
    """Company suffixes go from the end, repeatedly, but never the whole name."""
    return F.regexp_replace(name, f"^(.+?)(?:{COMPANY_SUFFIX})+$", "$1")


def normal_name(name: Column) -> Column:
    return without_suffix(_bare(name))


def normal_address(address: Column) -> Column:
    """Without white space and punctuation; no part of an address is cut off, as that would make two addresses one."""
    return F.regexp_replace(_bare(address), ADDRESS_MARKS, "")


def tax_id(text: Column) -> Column:
    """In capitals and trimmed; null if it is none."""
    bare = F.upper(F.trim(text))
    return F.when(is_tax_id(bare), bare)


def shared_id(kind: str, value: Column) -> Column:
    """Id of a node that stands for a private value: only its digest is kept."""
    return F.concat(F.lit(kind + ":"), F.substring(F.sha2(value, 256), 1, 16))


def address_id(address: Column) -> Column:
    return shared_id("ADDRESS", normal_address(address))


def person_id(name: Column, number: Column) -> Column:
    """Name and number together: neither alone tells people apart for good."""
    return shared_id("LEGALPERSON", F.concat_ws("|", normal_name(name), F.upper(F.trim(F.coalesce(number, F.lit(""))))))


def phone_id(number: Column) -> Column:
    return shared_id("PHONE", F.regexp_replace(nfkc(F.coalesce(number, F.lit(""))), r"[\s\-()（）]", ""))


def filename_hash(name: Column) -> Column:
    return F.sha2(name, 256)


def json_object(answer: Column) -> Column:
    """The JSON object in a model's answer: alone, in a code fence, or all from the first brace to the last; null where that is none. The built-in parser lets words after an object pass, so it can't tell."""

    @F.pandas_udf("string")
    def of(answers: pd.Series) -> pd.Series:
        def parsed(text: str) -> object:
            try:
                return json.loads(text)
            except ValueError:
                return None

        def one(text: str | None) -> str | None:
            bare = (text or "").strip()
            fence = re.fullmatch(r"(?s)```(?:json)?\s*(.*?)\s*```", bare)
            inner = fence.group(1) if fence else bare
            found = parsed(inner)
            if found is None and "{" in inner:
                inner = inner[inner.index("{") : inner.rfind("}") + 1]
                found = parsed(inner)
            return inner if isinstance(found, dict) else None

        return answers.map(one)

    return of(answer)


def terms(query: Column) -> Column:
    """What to look for: the query itself, its parts without stop words and marks, Han bigrams and ASCII words of those parts, each once."""
    whole = F.trim(F.coalesce(query, F.lit("")))
    plain = F.regexp_replace(F.regexp_replace(whole, "|".join(STOP_WORDS), " "), QUERY_MARKS, " ")
    han = lambda c: windows(F.regexp_replace(c, "[^一-鿿]", ""), 2)
    of = lambda c: F.concat(F.array(c), han(c), F.regexp_extract_all(c, F.lit("([A-Za-z0-9]{2,})"), 1))
    parts = F.flatten(F.transform(F.filter(F.split(plain, " "), lambda c: c != ""), of))
    return F.array_distinct(F.filter(F.concat(F.array(whole), parts), lambda t: t != ""))


def match_score(name: Column, query: Column, wanted: Column) -> Column:
    """How well a name answers a query, 100 to 40, null if not at all. wanted: terms(query)."""
    whole, others = F.trim(query), F.filter(wanted, lambda t: t != F.trim(query))
    chars = lambda c: F.array_distinct(F.split(c, ""))
    shared = F.size(F.array_intersect(chars(name), chars(whole)))
    tiers = F.when(whole == name, 100).when(F.contains(name, whole), 95).when(F.contains(whole, name), 90)
    tiers = tiers.when(F.exists(others, lambda t: t == name), 85).when(F.exists(others, lambda t: F.contains(name, t)), 70)
    tiers = tiers.when(F.exists(wanted, lambda t: (F.length(t) >= 2) & F.contains(t, name)), 65).when((shared >= 2) & (shared / F.length(name) >= 0.5), 40)
    return F.when((F.length(name) > 0) & (F.length(whole) > 0), tiers)


def character_overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct characters that a text has."""
    chars = lambda c: F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != ""))
    q = chars(query)
    return F.size(F.array_intersect(q, chars(text))) / F.greatest(F.size(q), F.lit(1))


def hash_embedding(text: Column, size: int = 256) -> Column:
    """Signed hashed bigrams as a vector of length one: the same on every machine, and no more than a stand-in for a model."""

    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[float]:
            t, v = t or "", np.zeros(size)
            for gram in [t[i : i + 2] for i in range(len(t) - 1)] or [t]:
                d = hashlib.blake2b(gram.encode("utf-8", "surrogatepass"), digest_size=8).digest()
                v[int.from_bytes(d[:2], "big") % size] += -1.0 if d[2] % 2 else 1.0
            norm = float(np.sqrt(v @ v))
            return (v / norm if norm else v).tolist()

        return texts.map(one)

    return of(text)


def coerced(text: Column) -> Column:
    """The kind of a CSV value and its canonical text: null, int, double or string."""
    bare = F.nullif(F.trim(text), F.lit(""))
    whole, number = bare.try_cast("bigint"), bare.try_cast("double")
    kind = F.when(bare.isNull(), "null").when(whole.isNotNull() & ~bare.contains("."), "int").when(number.isNotNull(), "double").otherwise("string")
    return F.struct(kind.alias("kind"), bare.alias("value"))


def fact_date(text: Column) -> Column:
    """The leading YYYY-MM-DD, or null."""
    return F.nullif(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def is_tax_id(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9A-HJ-NPQRTUWXY]{18}$"), F.lit(False))


def snippet(text: Column, size: int = 400) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("…"))).otherwise(text)


def _digits(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, _WIDE, _NARROW), "[^0-9]", "")


def mask_amount(text: Column) -> Column:
    return F.when(F.trim(text) == "", "").otherwise(AMOUNT_MASK)


def mask_invoice(text: Column) -> Column:
    bare = F.regexp_replace(F.translate(text, _WIDE, _NARROW), r"\s", "")
    return F.when(F.length(bare) < 8, FULL_MASK).otherwise(F.concat(F.substring(bare, 1, 4), F.lit("****"), F.right(bare, F.lit(4))))


def mask_phone(text: Column) -> Column:
    """First three and last four digits; fewer than eight digits go altogether."""
    d = _digits(text)
    return F.when(F.length(d) < 8, FULL_MASK).otherwise(F.concat(F.substring(d, 1, 3), F.lit("****"), F.right(d, F.lit(4))))


def mask_account(text: Column) -> Column:
    """First and last four digits, the middle as groups of four; fewer than nine digits go altogether."""
    d = _digits(text)
    groups = F.ceil((F.length(d) - 8) / 4).cast("int")
    return F.when(F.length(d) < 9, FULL_MASK).otherwise(F.concat_ws(" ", F.substring(d, 1, 4), F.trim(F.repeat(F.lit("**** "), groups)), F.right(d, F.lit(4))))


def mask_hashed(text: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt + "|"), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")), 256)


#: Which fields of a record are sensitive, by category.
SENSITIVE = {
    "amount": ("contract_amount", "amount"), "invoice": ("invoice_no", "invoice_number"), "hashed": ("tax_no", "tax_id", "legal_person", "legal_rep", "id_card", "id_no"),
    "account": ("bank_account", "bank_card"), "phone": ("phone", "mobile", "tel"), "filename": ("filename", "file_name"),
}


def masked(value: Column, category: str, salt: str) -> Column:
    """A value by its category; an unknown category raises rather than let the value through."""
    ways = {"amount": mask_amount, "invoice": mask_invoice, "account": mask_account, "phone": mask_phone, "filename": filename_hash, "hashed": lambda c: mask_hashed(c, salt)}
    return ways[category](value)


def masked_map(values: Column, salt: str, more: dict[str, str] | None = None) -> Column:
    """A map of strings with its sensitive fields masked. more: further fields and their categories."""
    fields = {f: c for c, fs in SENSITIVE.items() for f in fs} | (more or {})
    by = {c: [f for f in fields if fields[f] == c] for c in set(fields.values())}

    def one(key: Column, value: Column) -> Column:
        found = F.when(F.lit(False), value)
        for category in sorted(by):
            found = found.when(key.isin(*by[category]), masked(value, category, salt))
        return found.otherwise(value)

    return F.transform_values(values, one)


def _plain_mask(value: str, category: str, salt: str) -> str:
    even = value.translate(str.maketrans(_WIDE, _NARROW))
    digits, packed = "".join(c for c in even if c in _NARROW), "".join(even.split())
    if category == "amount":
        return AMOUNT_MASK if value.strip() else ""
    if category == "invoice":
        return FULL_MASK if len(packed) < 8 else f"{packed[:4]}****{packed[-4:]}"
    if category == "phone":
        return FULL_MASK if len(digits) < 8 else f"{digits[:3]}****{digits[-4:]}"
    if category == "account":
        return FULL_MASK if len(digits) < 9 else " ".join([digits[:4], *["****"] * -(-(len(digits) - 8) // 4), digits[-4:]])
    text = value if category == "filename" else f"{salt}|{''.join(c for c in value.lower() if c.isalnum())}"
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def masked_json(payload: Column, salt: str, more: dict[str, str] | None = None) -> Column:
    """A JSON object as text, its sensitive string fields masked at any depth, in objects inside lists too. What is no JSON object is masked whole, and so is a field whose category is unknown."""
    fields = {f: c for c, fs in SENSITIVE.items() for f in fs} | (more or {})
    known = set(SENSITIVE)

    @F.pandas_udf("string")
    def of(payloads: pd.Series) -> pd.Series:
        def walk(x: object, category: str | None = None) -> object:
            if isinstance(x, dict):
                return {k: walk(v, fields.get(k)) for k, v in x.items()}
            if isinstance(x, list):
                return [walk(v) for v in x]
            if isinstance(x, str) and category:
                return _plain_mask(x, category, salt) if category in known else FULL_MASK
            return x

        def one(text: str | None) -> str | None:
            if text is None:
                return None
            try:
                found = json.loads(text)
            except ValueError:
                return FULL_MASK
            return json.dumps(walk(found), ensure_ascii=False) if isinstance(found, dict) else FULL_MASK

        return payloads.map(one)

    return of(payload)


def redacted(line: Column) -> Column:
    """The value of NAME=value where the name speaks of a secret."""
    return F.regexp_replace(line, r"(?i)^(\s*[A-Z0-9_]*(?:KEY|SECRET|TOKEN|PASSWORD)[A-Z0-9_]*\s*=).*$", "$1***")
