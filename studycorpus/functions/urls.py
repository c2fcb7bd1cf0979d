"""URL expressions built on ``try_parse_url``."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from . import fixed_values as V
from .text import col, let

_PARTS = r"(?s)\A([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(?:#.*)?\z"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _PARTS, n)


def scheme(url) -> Column:
    return F.lower(_part(col(url), 1))


def authority(url) -> Column:
    return F.lower(_part(col(url), 2))


def host(url) -> Column:
    """Lower-case host without user info, port or trailing dot."""
    bare = F.regexp_replace(authority(url), r"\A.*@", "")
    return F.regexp_replace(F.regexp_replace(bare, r":\d*\z", ""), r"\.+\z", "")


def path(url) -> Column:
    return _part(col(url), 3)


def has_userinfo(url) -> Column:
    return authority(url).contains("@")


def query_value(url, key: str) -> Column:
    """First non-empty value of a query key, empty when missing."""
    return F.regexp_extract(_part(col(url), 4), rf"[?&]{key}=([^&]+)", 1)


def normalize(url) -> Column:
    """Lower-case scheme and authority, fragment dropped."""
    return let(url, lambda u: F.when(u.rlike(_PARTS), F.concat(
        scheme(u), F.lit("://"), authority(u), path(u), _part(u, 4))).otherwise(u))


def is_on_host(url, hosts) -> Column:
    """Exactly one of the hosts over http(s), never with user info."""
    u = col(url)
    bare = F.regexp_replace(authority(u), r":\d*\z", "")
    return scheme(u).isin("http", "https") & bare.isin(*hosts) & ~has_userinfo(u)


def host_allowed(url, hosts, subdomains: bool = False) -> Column:
    def allowed(h):
        hits = [h == x for x in hosts]
        if subdomains:
            hits += [h.endswith("." + x) for x in hosts]
        return (h != "") & reduce(lambda a, b: a | b, hits)

    return let(host(url), allowed)


def is_course(url, hosts) -> Column:
    return let(url, lambda u: F.coalesce(is_on_host(u, hosts), F.lit(False)) & path(u).endswith(V.COURSE_PATH_SUFFIX)
               & (query_value(u, "id") != ""))


def canonical_course(url) -> Column:
    """Course address with its first id only."""
    return let(F.trim(col(url)), lambda u: let(query_value(u, "id"), lambda ident: F.when(ident == "", normalize(u)).otherwise(
        F.concat(scheme(u), F.lit("://"), authority(u), path(u), F.lit("?id="), ident))))


def _without_dots(joined: Column) -> Column:
    """``.`` and ``..`` steps of a path taken out, one fold over its parts.

    A step back at the root is dropped. A last part that is a step leaves the
    folder, with its slash.
    """
    parts = F.split(joined, "/")
    step = lambda p: (p == ".") | (p == "..")
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: (
        F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
         .when(p == ".", done).otherwise(F.array_append(done, p))))
    return F.concat(F.array_join(folded, "/"), F.when(step(F.element_at(parts, -1)), "/").otherwise(""))


def resolve(base, href) -> Column:
    """Absolute form of a link found on a page."""
    b = col(base)
    root = F.concat(_part(b, 1), F.lit("://"), _part(b, 2))
    folder = F.coalesce(F.nullif(F.regexp_replace(path(b), r"[^/]*\z", ""), F.lit("")), F.lit("/"))

    def joined(h):
        """Path in front of ``?`` or ``#`` is folded, the rest stays."""
        steps = F.regexp_extract(h, r"(?s)\A[^?#]*", 0)
        whole = F.when(steps.startswith("/"), steps).otherwise(F.concat(folder, steps))
        return F.concat(root, _without_dots(whole), F.substr(h, F.length(steps) + 1))

    return let(F.trim(col(href)), lambda h: (
        F.when(h.rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*:"), h)
         .when(h.startswith("//"), F.concat(_part(b, 1), F.lit(":"), h))
         .when(h.startswith("?"), F.concat(root, path(b), h))
         .when(h.startswith("#") | (h == ""), F.concat(root, path(b), _part(b, 4)))
         .otherwise(joined(h))))


def canonical_link(url) -> Column:
    """Link of a catalog cell: redirects opened, fragment dropped, empty when it
    is no absolute URL."""
    def opened(u):
        target = query_value(u, "q")
        redirected = host(u).isin(*V.REDIRECT_HOSTS) & (path(u) == V.REDIRECT_PATH) & (target != "")
        return F.when(redirected, F.coalesce(F.try_url_decode(target), u)).otherwise(u)

    return let(let(F.trim(col(url)), opened), lambda t: F.when(
        t.rlike(_PARTS) & (authority(t) != ""), F.regexp_replace(t, r"(?s)#.*\z", "")).otherwise(""))


def _marked(p: Column) -> Column:
    return reduce(lambda a, b: a | b, [p.contains(m) for m in V.FILE_MARKERS])


def activity_type(url, hosts) -> Column:
    u = col(url)
    return let(F.lower(path(u)), lambda p: let(F.regexp_extract(p, r"/mod/([^/]+)/", 1), lambda mod: (
        F.when(mod != "", mod).when(_marked(p), "pluginfile").when(is_course(u, hosts), "course").otherwise("other"))))


def url_suffix(url) -> Column:
    return let(path(col(url)), lambda p: F.lower(F.regexp_extract(F.coalesce(F.try_url_decode(p), p), r"[^./](\.[^./]+)\z", 1)))


def is_file(url) -> Column:
    u = col(url)
    return let(F.lower(path(u)), _marked) | url_suffix(u).isin(*V.FILE_SUFFIXES)


def is_video(url) -> Column:
    return url_suffix(url).isin(*V.VIDEO_URL_SUFFIXES)


def link_kind(url, hosts) -> Column:
    """file / deep / course / interactive / other."""
    return let(activity_type(url, hosts), lambda kind: (
        F.when((kind == "pluginfile") | is_file(url), "file")
         .when(kind.isin(*V.DEEP_TYPES), "deep").when(kind == "course", "course")
         .when(kind.isin(*V.INTERACTIVE_TYPES), "interactive").otherwise("other")))


def material_key(url) -> Column:
    """Identity of a public file link; other links are their own identity."""
    def key(u):
        file_id, folder_id = F.regexp_extract(path(u), V.PUBLIC_FILE_ID, 1), F.regexp_extract(path(u), V.PUBLIC_FOLDER_ID, 1)
        named = (F.when(file_id != "", F.concat(F.lit("drive-file:"), file_id))
                  .when(folder_id != "", F.concat(F.lit("drive-folder:"), folder_id)))
        return F.when(host_allowed(u, V.PUBLIC_FILE_HOSTS), F.coalesce(named, u)).otherwise(u)

    return let(F.regexp_replace(F.trim(col(url)), r"#.*\z", ""), key)
