"""Operator 2: secret scan with multipart credential linking, in column functions only.

Strong parts (assignments of secrets, access key ids, long hexadecimal strings) are
always reported. Weak candidates (client names, opaque strings, endpoints) are reported
only where a complementary part stands in the same scope, a run of lines without a blank
line, within ``REACH`` code points: an identifier needs a secret, a secret an identifier
or an endpoint, an endpoint a secret. The interval join sweeps a document's parts and the
ends of its scopes in order of position, once from either end, and keeps for every role
only the nearest end seen in the scope, so it grows with the number of parts and never
leaves the row: there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import find_spans, let, scan

# The base patterns, and the least lengths of what they find.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE, ACCESS, HEX = 6, r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"

# Weak parts.
CLIENT = r"""(?i:client_?id|access_?id|user_?name|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})"""
OPAQUE = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"""(?i:https?|ftp|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9]|\.[0-9])"""
SCOPE = r"\n[\x20\t\r]*\n"

#: Kinds in order, with their roles; the first three are the base.
KINDS = ("assign", "access", "hex", "client", "opaque", "endpoint")
BASE_KINDS = 3
IDENTIFIER, SECRET, PLACE, BREAK = 1, 2, 3, 4
ROLES = (SECRET, IDENTIFIER, SECRET, IDENTIFIER, SECRET, PLACE)
REACH = 300

_FAR = 1 << 30


def _tagged(spans: Column, kind: int, role: int | None = None) -> Column:
    role = ROLES[kind] if role is None else role
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), F.lit(role).alias("role")))


def _swept(parts: Column, start: Column, step, emit) -> Column:  # noqa: ANN001
    """Whether ``emit`` holds for each part in a sweep from the left or in one from the
    right; both get the direction as a last argument."""
    left = scan(parts, start, lambda a, p: step(a, p, True), lambda a, p: emit(a, p, True), "array<boolean>")
    right = F.reverse(scan(F.reverse(parts), start, lambda a, p: step(a, p, False), lambda a, p: emit(a, p, False), "array<boolean>"))
    return F.zip_with(left, right, lambda x, y: x | y)


def _keep(parts: Column, keep: Column) -> Column:
    """The parts for which ``keep`` holds."""
    pairs = F.zip_with(parts, keep, lambda p, k: F.struct(p.alias("p"), k.alias("k")))
    return F.transform(F.filter(pairs, lambda x: x["k"]), lambda x: x["p"])


def _covered(parts: Column) -> Column:
    """Whether each part is a weak one that overlaps a strong one: the strong parts' farthest
    end before it, and their nearest start after it."""
    reach = lambda p, right: F.when(right, p["end"]).otherwise(-p["start"])
    edge = lambda p, right: F.when(right, p["start"]).otherwise(-p["end"])
    return _swept(
        parts,
        F.lit(-_FAR),
        lambda a, p, right: F.when(p["kind"] < BASE_KINDS, F.greatest(a, reach(p, F.lit(right)))).otherwise(a),
        lambda a, p, right: (p["kind"] >= BASE_KINDS) & (p["role"] != BREAK) & (a > edge(p, F.lit(right))),
    )


def _linked(parts: Column) -> Column:
    """Whether each part has a complementary one in its scope and within reach."""
    roles = {IDENTIFIER: "r1", SECRET: "r2", PLACE: "r3"}
    none = F.struct(*[F.lit(-_FAR).alias(n) for n in roles.values()])

    def step(a: Column, p: Column, right: bool) -> Column:
        end = p["end"] if right else -p["start"]
        seen = F.struct(*[F.when(p["role"] == r, F.greatest(a[n], end)).otherwise(a[n]).alias(n) for r, n in roles.items()])
        return F.when(p["role"] == BREAK, none).otherwise(seen)

    def emit(a: Column, p: Column, right: bool) -> Column:
        near = {r: (p["start"] if right else -p["end"]) - a[n] <= REACH for r, n in roles.items()}
        return F.when(p["role"] == SECRET, near[IDENTIFIER] | near[PLACE]).otherwise(near[SECRET])

    return _swept(parts, none, step, emit)


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_assign, n_access, n_hex,
    base_sha256, spans, n_weak, n_dropped.

    Base matches are leftmost and non-overlapping per kind; ``base_sha256`` is the SHA-256
    of kind:start:end of them in order of start, then kind, comma-joined; ``spans`` lists
    base and linked weak spans likewise (code points, ends exclusive). ``n_weak`` counts
    the weak spans reported and ``n_dropped`` the ones without a complement. Null and empty
    texts have no spans; repeated rows are reported once per row; other columns are not
    read."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    t = F.col("text")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    value = lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 1)) >= ASSIGN_VALUE
    d = d.select(
        "doc_id",
        "text",
        _tagged(F.filter(find_spans(t, ASSIGN), value), 0).alias("assign"),
        _tagged(find_spans(t, ACCESS), 1).alias("access"),
        _tagged(find_spans(t, HEX), 2).alias("hex"),
    )
    opaque = F.filter(find_spans(t, OPAQUE), lambda s: s["text"].rlike("[0-9]") & s["text"].rlike("[a-z]") & s["text"].rlike("[A-Z]"))
    d = d.select(
        "doc_id", "text", "assign", "access", "hex", _tagged(find_spans(t, CLIENT), 3).alias("client"), _tagged(opaque, 4).alias("opaque"), _tagged(find_spans(t, ENDPOINT), 5).alias("endpoint")
    )
    base = F.array_sort(F.concat("assign", "access", "hex"))
    weak = F.concat("client", "opaque", "endpoint")
    d = d.select("doc_id", "text", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"), base.alias("base"), weak.alias("weak"))
    some = (F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1)
    breaks = F.when(some, _tagged(find_spans(t, SCOPE), len(KINDS), BREAK))
    d = d.select("doc_id", "n_assign", "n_access", "n_hex", "base", "weak", F.when(some, F.array_sort(F.concat("base", "weak", breaks))).alias("parts"))

    def kept(parts: Column) -> Column:
        """What is reported, and the number of weak parts that are no strong part (an opaque
        string that overlaps one is that part)."""
        free = _keep(parts, F.transform(_covered(parts), lambda c: ~c))
        is_weak = lambda p: (p["kind"] >= BASE_KINDS) & (p["role"] != BREAK)
        return let(free, lambda f: F.struct(_keep(f, F.zip_with(f, _linked(f), lambda p, l: (p["kind"] < BASE_KINDS) | (is_weak(p) & l))).alias("kept"), F.size(F.filter(f, is_weak)).alias("n")))

    d = d.withColumn("x", F.when(F.col("parts").isNotNull(), let(F.col("parts"), kept)))
    d = d.select("doc_id", "n_assign", "n_access", "n_hex", "base", F.coalesce("x.n", F.size("weak")).alias("n"), F.coalesce("x.kept", "base").alias("kept"))
    found = (F.size("kept") - F.size("base")).cast("long")
    return d.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("kept")).alias("spans"), found.alias("n_weak"), (F.col("n") - found).alias("n_dropped"))
