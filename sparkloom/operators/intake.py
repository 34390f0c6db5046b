"""What is taken in and what is refused: uploads, repository and public urls, ids, messages to a bot, payment offers.

Refusals are reasons in the order they are checked; an empty reason is none. All are column functions; nulls count as
missing values.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions import fixed, url
from sparkloom.functions.text import trim_spaces

MOST_UPLOAD, MOST_URL = 15_000_000, 2048


def _has(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def upload_end(name: Column) -> Column:
    """The archive ending of a name in lower case, or empty."""
    low = F.lower(name)
    return functools.reduce(lambda out, e: F.when(F.endswith(low, F.lit(e)), e).otherwise(out), reversed(fixed.ARCHIVE_ENDS), F.lit(""))


def upload_reason(file_id: Column, name: Column, size: Column, most: int = MOST_UPLOAD) -> Column:
    return (
        F.when(~_has(file_id), "no file id").when(~F.coalesce(name.rlike(fixed.UPLOAD_NAME), F.lit(False)), "name").when(upload_end(name) == "", "format").when(size > most, "too large").when(size <= 0, "empty").otherwise("")
    )


def upload_kind(name: Column) -> Column:
    return F.when(upload_end(name) == ".zip", "zip").when(upload_end(name) != "", "tgz")


def is_server_path(path: Column) -> Column:
    return F.coalesce((F.length(path) <= 96) & path.rlike(fixed.SERVER_PATH), F.lit(False))


def is_archive(kind: Column, data: Column) -> Column:
    """Whether the first bytes are those of the kind."""
    head = F.hex(F.substring(data, 1, 4))
    return F.coalesce(F.when(kind == "zip", head.isin(*fixed.ZIP_HEADS)).when(kind == "tgz", F.startswith(head, F.lit(fixed.GZIP_HEAD))), F.lit(False))


def download_cap(transport: Column, requested: int = MOST_UPLOAD) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.least(F.lit(requested).cast("long"), transport.cast("long")))


def repository(address: Column, hosts: tuple[str, ...] = ("github.com",)) -> Column:
    """(owner, name, reason) of the page of a repository and nothing else."""
    u = F.trim(F.coalesce(address, F.lit("")))
    host, port, query = url.host(u), url.port(u), url.part(u, 4)
    bare = ~F.contains(url.netloc(u), F.lit("@")) & (port == "") & (query == "") & ~F.contains(u, F.lit("#"))
    steps = F.filter(F.split(url.part(u, 3), "/"), lambda x: x != "")
    owner, name = F.get(steps, F.lit(0)), F.regexp_replace(F.get(steps, F.lit(1)), r"\.git$", "")
    fine = F.coalesce(owner.rlike(fixed.REPOSITORY_NAME) & name.rlike(fixed.REPOSITORY_NAME), F.lit(False))
    reason = (
        F.when(u == "", "empty").when(F.length(u) > MOST_URL, "too long").when(url.scheme(u) != "https", "scheme").when(~host.isin(*hosts), "host").when(~bare, "not bare").when(F.size(steps) != 2, "path").when(~fine, "name").otherwise("")
    )
    return F.struct(F.when(reason == "", owner).alias("owner"), F.when(reason == "", name).alias("name"), reason.alias("reason"))


def is_branch(name: Column) -> Column:
    return F.coalesce(name.rlike(fixed.BRANCH_NAME) & ~F.contains(name, F.lit("..")), F.lit(False))


def ids(value: Column) -> Column:
    """(ids, open, bad) of a list of whole numbers; ``*`` opens it to all, anything else that is no number is bad."""
    parts = F.filter(F.split(F.trim(F.coalesce(value, F.lit(""))), r"[,\s;]+"), lambda x: x != "")
    named = F.filter(parts, lambda x: x != "*")
    read = F.transform(named, lambda x: x.try_cast("long"))
    return F.struct(F.array_compact(read).alias("ids"), F.array_contains(parts, "*").alias("open"), F.exists(read, lambda x: x.isNull()).alias("bad"))


def is_page_type(content_type: Column) -> Column:
    low = F.lower(F.coalesce(content_type, F.lit("")))
    return (low == "") | functools.reduce(Column.__or__, [F.contains(low, F.lit(x)) for x in fixed.PAGE_TYPES])


def is_public(address: Column) -> Column:
    """A web address without blanks, user, query, fragment and odd port, whose host is not known to be local."""
    bare = ~F.contains(url.netloc(address), F.lit("@")) & (url.part(address, 4) == "") & ~address.rlike("#.") & ((url.port(address) == "") | (url.port(address) == F.when(url.scheme(address) == "https", "443").otherwise("80")))
    return F.coalesce((F.length(address) <= MOST_URL) & ~address.rlike(r"(?U)\s") & bare & (url.unsafe_reason(address) == ""), F.lit(False))


def crawl_paths(path: Column, most: int = 4) -> Column:
    """A path and its decoded forms, all of which rules must allow; null where it is ambiguous or still encoded after ``most``."""

    def decoded(p: Column) -> Column:
        escaped = F.regexp_replace(F.regexp_replace(p, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
        return F.coalesce(F.try_url_decode(escaped), p)

    def unclear(p: Column) -> Column:
        return F.contains(p, F.lit("//")) | F.contains(p, F.lit("\\")) | F.exists(F.split(p, "/"), lambda s: s.isin(".", ".."))

    def step(a: Column, _: Column) -> Column:
        now = F.element_at(a["forms"], -1)
        after = decoded(now)
        done = a["done"] | (after == now)
        forms = F.when(done, a["forms"]).otherwise(F.array_append(a["forms"], after))
        return F.struct(forms.alias("forms"), done.alias("done"), (a["bad"] | (~a["done"] & unclear(now))).alias("bad"))

    start = F.when(F.coalesce(path, F.lit("")) == "", "/").otherwise(path)
    zero = F.struct(F.array(start).alias("forms"), F.lit(False).alias("done"), F.lit(False).alias("bad"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), zero, step, lambda a: F.when(a["done"] & ~a["bad"], a["forms"]))


def is_addressed(text: Column, me: str, from_bot: Column, reply_to_me: Column) -> Column:
    """Whether a message in a group is for ``me``: a command with the name, a reply, or a mention; of bots only the first."""
    t = F.trim(F.coalesce(text, F.lit("")))
    head = F.regexp_extract(t, r"^(\S+)", 1)
    command = F.startswith(head, F.lit("/")) & (F.lower(F.regexp_extract(head, "@(.*)$", 1)) == me.lower())
    return command | (~F.coalesce(from_bot, F.lit(False)) & (F.coalesce(reply_to_me, F.lit(False)) | F.contains(F.lower(t), F.lit(f"@{me.lower()}"))))


def unmentioned(text: Column, me: str) -> Column:
    """The text without ``@me``; if nothing else is there, as it was."""
    bare = F.trim(F.regexp_replace(text, rf"(?iU)@{me}\b", " "))
    return F.when(bare == "", text).otherwise(bare)


def blocks_sealing(severity: Column, rule: Column) -> Column:
    low = F.lower(F.coalesce(rule, F.lit("")))
    return F.lower(F.coalesce(severity, F.lit(""))).isin("high", "critical") & functools.reduce(Column.__or__, [F.contains(low, F.lit(x)) for x in fixed.SEALING_HINTS])


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def remembered(text: Column) -> Column:
    """Which group of old machines a text names, counted from 0; of several, one by the text's digest; null for none."""
    named = lambda low: F.array_compact(F.array(*[F.when(functools.reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words]), F.lit(i)) for i, words in enumerate(fixed.OLD_MACHINES)]))
    byte = F.conv(F.left(F.sha2(F.lower(trim_spaces(text)), 256), F.lit(2)), 16, 10).cast("int")
    pick = lambda hits: F.when(F.size(hits) > 0, F.get(hits, byte % F.greatest(F.size(hits), F.lit(1))))
    return _once(_once(F.lower(F.coalesce(text, F.lit(""))), named), pick)


OFFERS = "accepts array<struct<scheme:string,network:string,maxAmountRequired:string,amount:string,max_amount_required:string,payTo:string>>"


def cheapest_offer(headers: Column, body: Column, networks: tuple[str, ...]) -> Column:
    """(network, amount, pay_to) of the cheapest offer on a network, the first of equals; terms from a header, else the body."""
    lower = F.transform_keys(headers, lambda k, _: F.lower(k))
    terms = None
    for name in fixed.PAYMENT_HEADERS:
        raw = F.try_element_at(lower, F.lit(name))
        plain = F.try_to_binary(raw, F.lit("base64"))
        found = F.when(F.is_valid_utf8(plain.cast("string")) & F.get_json_object(plain.cast("string"), "$").isNotNull(), plain.cast("string")).when(F.get_json_object(raw, "$").isNotNull(), raw)
        terms = found if terms is None else F.coalesce(terms, found)
    terms = F.coalesce(terms, F.when(F.get_json_object(body, "$.accepts").isNotNull(), body))
    amount = lambda o: F.coalesce(o["maxAmountRequired"], o["amount"], o["max_amount_required"]).try_cast("decimal(38,0)")
    usable = F.filter(F.from_json(terms, OFFERS)["accepts"], lambda o: (F.coalesce(o["scheme"], F.lit("exact")) == "exact") & o["network"].isin(*networks))
    ranked = F.array_sort(F.transform(usable, lambda o, i: F.struct(amount(o).alias("amount"), i.alias("i"), o["network"].alias("network"), o["payTo"].alias("pay_to"))))
    best = F.get(ranked, F.lit(0))
    return F.when(F.size(usable) > 0, F.struct(best["network"].alias("network"), best["amount"].alias("amount"), best["pay_to"].alias("pay_to")))


def agent(value: Column) -> Column:
    """A caller's name without control characters, cut at 256; null if it would break a header."""
    return F.when(~F.coalesce(value, F.lit("")).rlike(r"[\r\n]"), F.left(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), F.lit(256)))


def watch_outcome(exists: Column, readable: Column, signature_fits: Column, breaking: Column, changes: Column, adopt: Column) -> Column:
    """(status, exit) of one pass over a tree: a first baseline, a refused one, a clean tree, drift, or drift that is adopted."""
    status = (
        F.when(~exists, "baseline-established").when(~readable, "error").when(~F.coalesce(signature_fits, F.lit(True)), "baseline-refused").when(changes == 0, "clean").when(adopt, "adopted").otherwise("drift")
    )
    code = F.when(status.isin("error", "baseline-refused"), 2).when(status != "drift", 0).when(breaking > 0, 1).otherwise(3)
    return F.struct(status.alias("status"), code.alias("exit"))


def is_inside(root: Column, path: Column) -> Column:
    top = F.regexp_replace(root, "/+$", "")
    return (path == top) | F.startswith(path, F.concat(top, F.lit("/")))


def in_range(value: Column, least: float, most: float) -> Column:
    """Whether a text is a finite number within bounds; words for truth are none."""
    number = F.when(~F.lower(value).isin("true", "false"), value.try_cast("double"))
    return F.coalesce(~F.isnan(number) & number.between(least, most), F.lit(False))
