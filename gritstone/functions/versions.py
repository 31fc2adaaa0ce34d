"""Sort keys of package versions: structs that order as their ecosystem does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ladder of release stages, lowest first.
STAGES = ("dev", "alpha", "beta", "rc", "stable", "patch")
NUMBER = r"0*\d{1,18}"  # longer numbers fit no key: versions with them are none
ALIASES = {"a": "alpha", "b": "beta", "c": "rc", "pre": "rc", "preview": "rc", "p": "patch", "pl": "patch", "post": "patch"}


def _once(value: Column, use) -> Column:
    """What ``use`` makes of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _groups(version: Column, shape: str, n: int, build) -> Column:
    """What ``build`` makes of the first n groups of a shape, taken apart in one match; null where it does not match.

    ``build`` gets the group of a number, null if it is empty. No group may hold a slash.
    """
    parts = F.split(F.regexp_replace(version, shape, "".join(f"${k + 1}/" for k in range(n))), "/")
    return F.when(version.rlike(shape), _once(parts, lambda p: build(lambda k: F.nullif(p[k - 1], F.lit("")))))


def _plain(version: Column) -> Column:
    """In lower case, without white space around it and the v before it."""
    return F.regexp_replace(F.lower(F.regexp_replace(version, r"^\s+|\s+$", "")), "^v", "")


def _number(text: Column) -> Column:
    return F.coalesce(text.cast("long"), F.lit(0).cast("long"))


def _release(text: Column) -> Column:
    """The numbers of a release without trailing zeros."""
    return F.transform(F.split(F.regexp_replace(text, r"(?:\.0+)+$", ""), r"\."), lambda x: x.cast("long"))


def semver_key(version: Column) -> Column:
    """(major, minor, patch, released) or null; missing parts are 0, build data is dropped.

    Two pre-releases of one version are equal, and both come before it.
    """
    shape = r"^(\d{1,18})(?:\.(\d{1,18}))?(?:\.(\d{1,18}))?(-.*)?$"

    def key(v: Column) -> Column:
        released = F.length(F.regexp_extract(v, shape, 4)) < 2
        return _groups(v, shape, 3, lambda got: F.struct(_number(got(1)).alias("major"), _number(got(2)).alias("minor"), _number(got(3)).alias("patch"), released.alias("released")))

    return _once(F.regexp_replace(F.regexp_replace(version, r"^\s*v?|\s+$", ""), r"\+.*$", ""), key)


def staged_key(version: Column) -> Column:
    """(release numbers without trailing zeros, stage, number) or null, as Composer orders; branches are no versions."""
    shape = rf"^({NUMBER}(?:\.{NUMBER})*)(?:-(alpha|beta|stable|patch|dev|rc|pl|a|b|p)[.-]?((?:{NUMBER})?))?$"
    places = {name: STAGES.index(ALIASES.get(name, name)) for name in (*STAGES, *ALIASES)}

    def key(got) -> Column:
        place = F.try_element_at(F.create_map(*[F.lit(x) for pair in places.items() for x in pair]), got(2))
        return F.struct(_release(got(1)).alias("release"), F.coalesce(place, F.lit(STAGES.index("stable"))).alias("stage"), _number(got(3)).alias("number"))

    return _once(_plain(version), lambda v: _groups(v, shape, 3, key))


def pep440_key(version: Column) -> Column:
    """(epoch, release, pre, pre number, post, dev, local) or null, ordering as PEP 440 says.

    ``pre``: -1 for a bare development release, 0 a, 1 b, 2 rc, 3 none. Post is -1
    and dev is the largest number where absent. Local labels compare as text parts.
    """
    shape = (
        rf"^(?:({NUMBER})!)?({NUMBER}(?:\.{NUMBER})*)(?:[._-]?(alpha|a|beta|b|preview|pre|c|rc)[._-]?((?:{NUMBER})?))?"
        rf"(?:-({NUMBER})|[._-]?(post|rev|r)[._-]?((?:{NUMBER})?))?(?:[._-]?(dev)[._-]?((?:{NUMBER})?))?(?:\+([a-z0-9]+(?:[._-][a-z0-9]+)*))?$"
    )

    def key(got) -> Column:
        has_post = got(5).isNotNull() | got(6).isNotNull()
        has_dev = got(8).isNotNull()
        pre = (
            F.when(got(3).isin("a", "alpha"), 0).when(got(3).isin("b", "beta"), 1).when(got(3).isNotNull(), 2).when(has_dev & ~has_post, -1).otherwise(3)
        )
        return F.struct(
            _number(got(1)).alias("epoch"),
            _release(got(2)).alias("release"),
            pre.alias("pre"),
            _number(got(4)).alias("pre_number"),
            F.when(has_post, F.coalesce(got(5).cast("long"), _number(got(7)))).otherwise(F.lit(-1).cast("long")).alias("post"),
            F.when(has_dev, _number(got(9))).otherwise(F.lit(2**62)).alias("dev"),
            F.coalesce(got(10), F.lit("")).alias("local"),
        )

    return _once(_plain(version), lambda v: _groups(v, shape, 10, key))
