"""URL filters: host rules, and a weighted vocabulary matched by Aho-Corasick."""

from __future__ import annotations

import string
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.llm.common import fresh

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: The vocabulary by category: one strict term rejects; soft terms have weights from 1 (common in honest shops) to 3 (rare there),
#: and LEAST_SOFT or more distinct ones that weigh REJECT_AT or more together reject: two heavy ones, or several light ones.
STRICT_TERMS = {
    "gambling": ("casino", "casinos", "jackpot", "roulette", "blackjack", "sportsbook", "betting"),
    "adult": ("porn", "porno", "xxx", "escort", "escorts", "hentai", "camgirls"),
    "pharmacy": ("viagra", "cialis", "tramadol", "xanax"),
    "abuse": ("spam", "malware", "phishing", "keygen", "warez", "ransomware"),
    "piracy": ("torrent", "torrents", "crackz"),
}
SOFT_TERMS = {
    "commerce": {"cheap": 1, "deal": 1, "deals": 1, "sale": 1, "discount": 1, "coupon": 1, "coupons": 1, "free": 1, "bonus": 2, "offer": 1, "outlet": 1},
    "gambling": {"bet": 2, "bets": 2, "win": 1, "slots": 2, "poker": 3, "lottery": 3, "odds": 1},
    "adult": {"adult": 2, "dating": 2, "singles": 2, "nude": 3, "webcam": 1},
    "pharmacy": {"pills": 2, "pharmacy": 1, "meds": 2, "dosage": 1},
    "finance": {"loan": 1, "loans": 1, "payday": 3, "crypto": 2, "forex": 2, "refinance": 1},
    "tracking": {"ads": 2, "track": 1, "tracker": 2, "click": 1, "affiliate": 2, "popup": 2, "banner": 1},
    "farms": {"farm": 1, "linkfarm": 3, "seo": 1, "backlinks": 3},
}
STRICT = tuple(t for terms in STRICT_TERMS.values() for t in terms)
SOFT = {t: w for terms in SOFT_TERMS.values() for t, w in terms.items()}
LEAST_SOFT, REJECT_AT = 2, 4


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased;
    path: then up to "?", "#" or the end. Null or without "://": both empty."""
    at = F.locate("://", url)
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.regexp_extract(after, r"(?s)^([^/?#]*)([^?#]*)", 2)
    return ascii_lower(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)), rest


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path joined, and its verdict; nulls if none."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


@lru_cache(maxsize=4)
def automaton(strict: tuple, soft: tuple) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for term, weight in [*((t, None) for t in strict), *soft]:
        a.add_word(term, (term, weight))
    a.make_automaton()
    return a


def hits(url: str, strict: tuple, soft: tuple) -> tuple[set[str], dict[str, int]]:
    """The strict terms and the soft terms with weights that stand between boundaries: no letter or digit beside them."""
    found_strict, found_soft = set(), {}
    low = url.lower() if url.isascii() else "".join(c.lower() if c.isascii() else c for c in url)
    for end, (term, weight) in automaton(strict, soft).iter(low):
        start = end - len(term) + 1
        if (start and low[start - 1].isalnum()) or (end + 1 < len(low) and low[end + 1].isalnum()):
            continue
        if weight is None:
            found_strict.add(term)
        else:
            found_soft[term] = weight
    return found_strict, found_soft


VOCABULARY_HITS = T.StructType([T.StructField("strict_hits", T.LongType()), T.StructField("soft_hits", T.LongType()), T.StructField("soft_weight", T.LongType()), T.StructField("reject", T.BooleanType())])
_HITS = pa.struct([("strict_hits", pa.int64()), ("soft_hits", pa.int64()), ("soft_weight", pa.int64()), ("reject", pa.bool_())])


def filter_urls(df: DataFrame, url: str = "url", rules=RULES, strict=STRICT, soft=None, reject_at: int = REJECT_AT) -> DataFrame:
    """Add host, path, rule, verdict ("allow" or "block"), strict_hits, soft_hits and soft_weight.

    The longest fitting rule decides; without one, the vocabulary: one strict term
    blocks, and so do LEAST_SOFT or more distinct soft terms that weigh reject_at or more together. A
    null or empty url has no host, path or hits and is allowed; urls of any length
    are read whole. Existing columns of the names added are replaced, all others, whatever
    their names, pass through. Every row is judged by itself, so repeated rows get equal
    verdicts, and an empty df gives no rows.
    """
    strict, soft = tuple(strict), tuple((SOFT if soft is None else soft).items())
    name, named_hits, ruled = fresh("_url", df), fresh("_hits", df), fresh("_verdict", df)

    @F.arrow_udf(VOCABULARY_HITS)
    def vocabulary(urls: pa.Array) -> pa.Array:
        rows = []
        for u in urls:
            s, w = hits(u.as_py() or "", strict, soft)
            weight = sum(w.values())
            rows.append({"strict_hits": len(s), "soft_hits": len(w), "soft_weight": weight, "reject": bool(s) or (len(w) >= LEAST_SOFT and weight >= reject_at)})
        return pa.array(rows, _HITS)

    named = df.withColumn(name, F.coalesce(F.col(url), F.lit("")))
    host, path = host_and_path(F.col(name))
    named = named.withColumns({"host": host, "path": path, named_hits: vocabulary(F.col(name))})
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    named, found = named.withColumns({"rule": rule, ruled: verdict}), F.col(named_hits)
    return named.withColumns(
        {
            "verdict": F.coalesce(F.col(ruled), F.when(found["reject"], "block").otherwise("allow")),
            "strict_hits": found["strict_hits"],
            "soft_hits": found["soft_hits"],
            "soft_weight": found["soft_weight"],
        }
    ).drop(name, named_hits, ruled)


def _hits_sql(terms: str) -> str:
    edge = "[^\\p{L}\\p{N}]"
    return f"list_filter({terms}, lambda t: contains(low, t) AND regexp_matches(low, '(^|{edge})' || t || '({edge}|$)'))"


FILTER_SQL = f"""
    WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
    cut AS (SELECT *, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
                   translate(url, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS low FROM u),
    named AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    found AS (SELECT *, {_hits_sql(repr(list(STRICT)))} AS strict, {_hits_sql(repr(list(SOFT)))} AS soft FROM named),
    weighed AS (SELECT *, coalesce(list_sum(list_transform(soft, lambda t: CASE {" ".join(f"WHEN list_contains({[t for t, v in SOFT.items() if v == w]!r}, t) THEN {w}" for w in sorted(set(SOFT.values())))} END)), 0) AS weight,
        CASE {" ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))} END AS rule FROM found)
    SELECT page_id, host, path, rule,
           CASE {" ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in RULES)}
                WHEN len(strict) > 0 OR (len(soft) >= {LEAST_SOFT} AND weight >= {REJECT_AT}) THEN 'block' ELSE 'allow' END AS verdict,
           len(strict)::BIGINT AS strict_hits, len(soft)::BIGINT AS soft_hits
    FROM weighed
"""
