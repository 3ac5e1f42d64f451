"""Windows-style path functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold_case

SLASH = "\\"
# Characters that a file or folder name can't hold.
BAD_IN_FILE = r'[\x00-\x1f"<>|:*?\\/]'
BAD_IN_FOLDER = r"[\x00-\x1f|]"


def with_slash(path: Column) -> Column:
    return F.when((path == "") | path.endswith(SLASH), path).otherwise(F.concat(path, F.lit(SLASH)))


def is_or_contains(path: Column, inner: Column) -> Column:
    return fold_case(with_slash(inner)).startswith(fold_case(with_slash(path)))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def folder_of(path: Column) -> Column:
    """Folder of a file; that of ``c:\\x`` is ``c:\\``."""
    up = F.regexp_replace(path, r"\\[^\\]*$", "")
    return F.when(up.rlike("^[A-Za-z]:$"), F.concat(up, F.lit(SLASH))).otherwise(up)


def relative_to_folder(path: Column, folder: Column) -> Column:
    """Path of a file as seen from a folder; of a file on another drive only the name."""
    parts = lambda x: F.split(F.rtrim(x, F.lit(SLASH)), r"\\")
    a, b = parts(folder), parts(path)
    n = F.least(F.size(a), F.size(b))
    same = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda m, i: F.when((m == i) & (fold_case(F.get(a, i)) == fold_case(F.get(b, i))), m + 1).otherwise(m))
    ups = F.size(a) - same
    below = F.array_join(F.slice(b, same + 1, F.size(b)), SLASH)
    tail = F.when(path.endswith(SLASH) & (below != ""), F.lit(SLASH)).otherwise(F.lit(""))
    return F.when(F.substring(path, 1, 1) != F.substring(folder, 1, 1), file_name(path)).otherwise(F.concat(F.repeat(F.lit("..\\"), ups), below, tail))


def relative_to_file(path: Column, other: Column) -> Column:
    """Path of a file as seen from the folder of another."""
    return relative_to_folder(path, folder_of(other))


def relative_to_root(path: Column, root: Column) -> Column:
    """``../`` for each folder between a file and the root."""
    below = F.substring(path, F.length(root) + 2, F.length(path))
    return F.repeat(F.lit("../"), F.length(below) - F.length(F.regexp_replace(below, r"[\\/]", "")))


def path_in_cone(folder: Column, path: Column) -> Column:
    """The path itself if it is in the folder, else what it doesn't share with the folder, planted into it."""
    whole = F.when(path.rlike(r"^(?:[A-Za-z]:)?\\"), path).otherwise(F.concat(with_slash(folder), path))
    a, b = F.split(folder, r"\\"), F.split(whole, r"\\")
    n = F.least(F.size(a), F.size(b))
    same = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda m, i: F.when((m == i) & (fold_case(F.get(a, i)) == fold_case(F.get(b, i))), m + 1).otherwise(m))
    rest = F.replace(F.array_join(F.slice(b, same + 1, F.size(b)), SLASH), F.lit(":"), F.lit(""))
    return F.when(fold_case(whole).startswith(fold_case(folder)), whole).otherwise(F.concat(with_slash(folder), rest))


def sanitize_file(name: Column) -> Column:
    return F.regexp_replace(name, BAD_IN_FILE, "_")


def sanitize_folder(name: Column) -> Column:
    named = F.when(name == ".", F.lit("current")).when(name == "..", F.lit("parent")).otherwise(F.rtrim(name, F.lit(":")))
    return F.regexp_replace(named, BAD_IN_FOLDER, "_")


def strip_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^.\\/]*$", "")


def relative_in_project(folders: Column, name: Column) -> Column:
    return F.array_join(F.concat(F.transform(folders, sanitize_folder), F.array(name)), SLASH)


def display_link(from_assembly: Column, to_assembly: Column, path: Column, line: Column) -> Column:
    page = F.concat(F.replace(path, F.lit(SLASH), F.lit("/")), F.lit(".html#"), line.cast("string"))
    return F.when(from_assembly == to_assembly, F.concat(F.lit("../"), page)).otherwise(F.concat(F.lit("../../"), from_assembly, F.lit("/"), page))


def mapped_url(path: Column) -> Column:
    """Destination of a project or script file."""
    out = F.replace(F.translate(path, ": ", ""), F.lit("\\bin\\"), F.lit("\\bin_\\"))
    return F.concat(F.regexp_replace(out, r"^\\\\", ""), F.lit(".html"))


def folder_chain(namespace: Column) -> Column:
    """Folders of a namespace; null if a part is not a plain name."""
    parts = F.split(namespace, r"\.")
    return F.when(F.forall(parts, lambda p: p.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$")), parts)
