"""Which folders may be read or watched, as Column expressions on their paths.

A path is cut into segments once: Windows paths by either slash, a drive first, others
by ``/``; ``.`` and ``..`` are resolved, case and trailing dots count only where the
system lets them. What it must not be is said by its segments alone, so no disk is
looked at and the rule holds for paths of other machines.

Defined results: a null or blank path is empty; quotes around a path are taken off;
``..`` above the root stays at the root; a relative path is refused as such.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First folders of a system, and folders of settings and secrets anywhere.
SYSTEM_WINDOWS = ("windows", "windows.old", "program files", "program files (x86)", "programdata", "$recycle.bin", "system volume information")
SYSTEM_POSIX = ("etc", "usr", "bin", "sbin", "lib", "lib64", "proc", "sys", "dev", "boot", "root", "var", "run", "opt", "snap")
HIDDEN = (".git", ".ssh", ".gnupg", ".aws", ".config", "appdata", "node_modules", "__pycache__")
HOMES = ("home", "users")

_DRIVE = r"^[A-Za-z]:([\\/]|$)"


def cleaned(path: Column) -> Column:
    """Without white space and quotes around it."""
    s = F.trim(F.coalesce(path, F.lit("")))
    for _ in range(3):
        s = F.trim(F.regexp_replace(s, r"""^(["'`“”‘’])(.*)["'`“”‘’]$""", "$2"))
    return s


def is_windows(path: Column) -> Column:
    return path.rlike(_DRIVE) | path.rlike(r"^(\\\\|//)")


def segments(path: Column) -> Column:
    """The resolved segments, in lower case where case doesn't count; a drive is the first."""
    s = cleaned(path)
    windows = is_windows(s)
    raw = F.when(windows, F.split(F.lower(s), r"[\\/]+")).otherwise(F.split(s, "/+"))
    tidy = F.filter(F.transform(raw, lambda x: F.when(windows & ~x.isin(".", ".."), F.regexp_replace(x, r"(?<=[^. ])[. ]+$", "")).otherwise(x)), lambda x: ~x.isin("", "."))
    least = F.when(windows & s.rlike(_DRIVE), 1).otherwise(0)
    step = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.least(least, F.size(done))))).otherwise(F.concat(done, F.array(x)))
    return F.aggregate(tidy, F.array().cast("array<string>"), step)


def is_inside(path: Column, folder: Column) -> Column:
    """Whether a path is a folder or lies below it."""
    a, b = segments(path), segments(folder)
    return (is_windows(cleaned(path)) == is_windows(cleaned(folder))) & (F.size(a) >= F.size(b)) & (F.slice(a, F.lit(1), F.size(b)) == b)


def refused(path: Column, own: str | None = None, allowed: tuple[str, ...] = ()) -> Column:
    """Why a folder must not be read, '' if it may. ``own``: the data folder of the
    application, of which only the folders ``allowed`` may be read."""
    s = cleaned(path)
    windows, drive = is_windows(s), s.rlike(_DRIVE)
    found = segments(path)
    below = F.when(drive, F.slice(found, F.lit(2), F.greatest(F.size(found) - 1, F.lit(0)))).otherwise(found)
    first = F.lower(F.coalesce(F.get(below, F.lit(0)), F.lit("")))
    system = F.when(windows, first.isin(*SYSTEM_WINDOWS)).otherwise(first.isin(*SYSTEM_POSIX))
    home = first.isin(*HOMES) & (F.size(below) <= 2)
    hidden = F.exists(below, lambda x: F.lower(x).isin(*HIDDEN))
    mine = F.lit(False)
    if own is not None:
        within = is_inside(path, F.lit(own))
        for name in allowed:
            within = within & ~is_inside(path, F.lit(f"{own.rstrip('/')}/{name}"))
        mine = within | is_inside(F.lit(own), path)
    return (
        F.when(s == "", "empty")
        .when(~windows & ~s.startswith("/"), "relative")
        .when(F.size(below) == 0, "root")
        .when(system, "system")
        .when(home, "home")
        .when(hidden, "hidden")
        .when(mine, "own data")
        .otherwise("")
    )
