"""String, conditional, number and blob functions with the dialect's semantics, as Column builders.

Each stays in generated code: no Python runs on the executors.
"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F



def _c(x):
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def any_null(*xs):
    return reduce(lambda a, b: a | b, (x.isNull() for x in xs))


def smallest(*xs):
    """min(X, Y, ...): null if any is."""
    xs = [*map(_c, xs)]
    return F.when(~any_null(*xs), F.least(*xs))


def largest(*xs):
    """max(X, Y, ...): null if any is."""
    xs = [*map(_c, xs)]
    return F.when(~any_null(*xs), F.greatest(*xs))


def concat(*xs):
    """Nulls count as empty."""
    return F.concat_ws("", *(_c(x).cast("string") for x in xs))


def glob_pattern(glob: str) -> str:
    """The regular expression of a GLOB pattern: *, ?, [..] and [^..]."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[" and (end := glob.find("]", i + 2 + (glob[i + 1 : i + 2] == "^"))) > 0:
            inner = glob[i + 1 : end]
            negate, inner = inner.startswith("^"), inner.removeprefix("^")
            out.append("[" + "^" * negate + "".join("\\" + c if c in "\\[]&^" else c for c in inner) + "]")
            i = end
        else:
            out.append("\\" + ch if ch in r"\.^$|()[]{}+*?" else ch)
        i += 1
    return f"(?s)^{''.join(out)}$"


def glob(pattern: str, x):
    return _c(x).rlike(glob_pattern(pattern))


def like(pattern: str, x, escape: str | None = None):
    """ASCII letters match either case."""
    return F.ilike(_c(x), F.lit(pattern), *([F.lit(escape)] if escape else []))


def substr(x, start: int, length: int | None = None):
    """1-based, negative from the end; a start of 0 takes one place of the length; a negative length takes what stands before."""
    x = _c(x)
    size = F.char_length(x)
    first = F.lit(start) if start > 0 else F.lit(0) if start == 0 else size + start + 1
    stop = size + 1 if length is None else first + length
    low, high = (F.least(first, stop), F.greatest(first, stop)) if length is not None and length < 0 else (first, stop)
    begin = F.greatest(low, F.lit(1))
    return F.when(x.isNull(), F.lit(None)).otherwise(F.substring(x, begin, F.greatest(high - begin, F.lit(0))))


def pad(x, size: int, fill: str, left: bool):
    x = _c(x)
    return (F.lpad if left else F.rpad)(x, size, fill) if fill else x


def trim(x, characters: str | None = None, side: str = "both"):
    own = {"both": F.btrim, "left": F.ltrim, "right": F.rtrim}[side]
    return own(_c(x), F.lit(" " if characters is None else characters))


def quote(x, kind: str = "text"):
    """SQL literal text of a value."""
    x = _c(x)
    text = {"text": F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'")) if kind == "text" else None, "number": x.cast("string") if kind == "number" else None, "blob": F.concat(F.lit("X'"), F.hex(x), F.lit("'")) if kind == "blob" else None}[kind]
    return F.coalesce(text, F.lit("NULL"))


def unhex(x, ignore: str = ""):
    return F.unhex(F.translate(_c(x), ignore, "") if ignore else _c(x))


def char(*codes):
    """Text of code points; each by its UTF-8 bytes."""
    return F.concat(*(F.decode(F.unhex(F.lit(chr(c).encode().hex())), "UTF-8") for c in codes))


def unicode(x):
    """The first character's code point."""
    raw = F.encode(F.substring(_c(x), 1, 1), "UTF-32")
    return F.when(F.char_length(_c(x)) > 0, F.conv(F.hex(raw), 16, 10).cast("long"))


def zeroblob(n: int):
    return F.unhex(F.lit("00" * n))


def get_byte(x, n: int):
    return F.conv(F.hex(F.substring(_c(x), n + 1, 1)), 16, 10).cast("int")


def set_byte(x, n: int, value: int):
    x = _c(x)
    return F.concat(F.substring(x, 1, n), F.unhex(F.lit(f"{value:02X}")), F.substring(x, F.lit(n + 2), F.octet_length(x)))


def typeof(x, data_type: str):
    """The storage class of a column of a Spark type."""
    kind = "integer" if data_type in ("tinyint", "smallint", "int", "bigint", "boolean") else "real" if data_type in ("float", "double") or data_type.startswith("decimal") else "blob" if data_type == "binary" else "text"
    return F.when(_c(x).isNull(), "null").otherwise(kind)


def to_integer(x):
    """CAST(text AS INTEGER): the longest integer prefix, else 0."""
    x = _c(x)
    return F.when(x.isNull(), F.lit(None)).otherwise(F.coalesce(F.regexp_extract(x, r"^\s*([+-]?[0-9]+)", 1).try_cast("long"), F.lit(0).cast("long")))


def to_real(x):
    """CAST(text AS REAL): the longest number prefix, else 0."""
    x = _c(x)
    return F.when(x.isNull(), F.lit(None)).otherwise(F.coalesce(F.regexp_extract(x, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double"), F.lit(0.0)))


def int_div(x, y):
    """Integer quotient towards zero; null for a divisor of 0."""
    return F.call_function("div", _c(x), F.nullif(_c(y), F.lit(0)))


def add(x, y):
    """Integer sum; an overflow becomes a real."""
    x, y = _c(x), _c(y)
    return F.coalesce(F.try_add(x, y).cast("double"), x.cast("double") + y.cast("double"))


def shift_left(x, n):
    """Saturates at 64 places; negative counts shift right."""
    x, n = _c(x).cast("long"), _c(n)
    left = lambda k: F.when(k >= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", x, k.cast("int")))
    right = lambda k: F.when(k >= 64, F.when(x < 0, F.lit(-1)).otherwise(F.lit(0)).cast("long")).otherwise(F.call_function("shiftright", x, k.cast("int")))
    return F.when(n >= 0, left(n)).otherwise(right(-n))


def shift_right(x, n):
    return shift_left(x, -_c(n))


def iif(condition, yes, no=None):
    return F.when(condition, _c(yes)).otherwise(_c(no) if no is not None else F.lit(None))


# --- mathematics: outside their domains functions are null ---


def real(x):
    return F.when(~F.isnan(x), x)


def domain(function, *xs):
    return real(function(*(_c(x).cast("double") for x in xs)))


def log(x, base=None):
    """Base 10 with one argument."""
    x = _c(x).cast("double")
    return F.when(x > 0, F.log10(x)) if base is None else F.when((x > 0) & (_c(base) > 0) & (_c(base) != 1), F.ln(x) / F.ln(_c(base).cast("double")))


def trunc(x):
    x = _c(x).cast("double")
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def sign(x):
    return F.signum(_c(x).cast("double")).cast("long")


def round_half_up(x, places: int = 0):
    return F.round(_c(x).cast("double"), places)


def gcd(x, y):
    """Euclid's steps unrolled over a fixed sequence: 64-bit numbers need at most 92."""
    start = F.struct(F.abs(_c(x).cast("long")).alias("a"), F.abs(_c(y).cast("long")).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], F.lit(0).cast("long"))).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])


def lcm(x, y):
    """In whole numbers; null if either is null; beyond 64 bits an error."""
    x, y = _c(x).cast("long"), _c(y).cast("long")
    product = F.try_multiply(F.call_function("div", F.abs(x), F.nullif(gcd(x, y), F.lit(0).cast("long"))), F.abs(y))
    value = F.when((x == 0) | (y == 0), F.lit(0).cast("long")).when(product.isNull(), F.raise_error(F.lit("integer overflow")).cast("long")).otherwise(product)
    return F.when(~any_null(x, y), value)


# --- fuzzy ---


def hamming(x, y):
    """Places that differ; null for different lengths."""
    a, b = F.split(_c(x), ""), F.split(_c(y), "")
    return F.when(F.char_length(_c(x)) == F.char_length(_c(y)), F.size(F.filter(F.zip_with(a, b, lambda p, q: p != q), lambda d: d)))


def jaro_winkler(x, y):
    """Jaro-Winkler similarity by an Arrow UDF: matching depends on earlier matches."""
    import pandas as pd

    @F.pandas_udf("double")
    def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(s, t):
            if s is None or t is None:
                return None
            if s == t:
                return 1.0
            reach, used, hits = max(len(s), len(t)) // 2 - 1, [False] * len(t), []
            for i, ch in enumerate(s):
                for j in range(max(0, i - reach), min(len(t), i + reach + 1)):
                    if not used[j] and t[j] == ch:
                        used[j] = True
                        hits.append(ch)
                        break
            if not hits:
                return 0.0
            other = [ch for ch, u in zip(t, used, strict=True) if u]
            half = sum(p != q for p, q in zip(hits, other, strict=True)) / 2
            m = len(hits)
            score = (m / len(s) + m / len(t) + (m - half) / m) / 3
            same = 0
            for p, q in zip(s[:4], t[:4], strict=False):
                if p != q:
                    break
                same += 1
            return score + same * 0.1 * (1 - score) if score > 0.7 else score

        return pd.Series([one(p, q) for p, q in zip(a, b, strict=True)])

    return jaro(_c(x), _c(y))


# --- network ---


def _ipv4(x):
    part = F.split(x, r"\.")
    valid = x.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
    number = reduce(lambda a, b: a * 256 + b, (F.get(part, F.lit(i)).try_cast("long") for i in range(4)))
    return F.when(valid, number)


def ip_family(x):
    x = F.split_part(_c(x), F.lit("/"), F.lit(1))
    return F.when(_ipv4(x).isNotNull(), 4).when(x.rlike(r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*$"), 6)


def ip_host(x):
    return F.split_part(_c(x), F.lit("/"), F.lit(1))


def ip_mask_length(x):
    return F.when(_c(x).contains("/"), F.split_part(_c(x), F.lit("/"), F.lit(2)).try_cast("int"))


def ip_network(x):
    """The network of an IPv4 address with mask length."""
    bits = ip_mask_length(x)
    size = F.pow(F.lit(2.0), 32 - bits).cast("long")
    base = _ipv4(ip_host(x))
    first = base - base % size
    dots = [F.floor(first / 256**k) % 256 for k in (3, 2, 1, 0)]
    return F.concat(F.concat_ws(".", *(d.cast("long").cast("string") for d in dots)), F.lit("/"), bits.cast("string"))


def ip_contains(network, address):
    """Whether an IPv4 network holds an address."""
    size = F.pow(F.lit(2.0), 32 - ip_mask_length(network)).cast("long")
    return F.floor(_ipv4(ip_host(network)) / size) == F.floor(_ipv4(ip_host(address)) / size)


# --- UUID ---


def uuid_blob(text):
    return F.unhex(F.replace(_c(text), F.lit("-"), F.lit("")))


def uuid_str(blob):
    h = F.lower(F.hex(_c(blob)))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def uuid7_timestamp_ms(text):
    return F.conv(F.substring(F.replace(_c(text), F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("long")


def uuid7():
    ms = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0")
    rest = F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))
    h = F.concat(ms, F.lit("7"), F.substring(rest, 1, 3), F.lit("8"), F.substring(rest, 4, 15))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
