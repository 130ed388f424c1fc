"""Identity strings and small classifications of collected records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
ZERO = "\0"

#: Session sources whose usage belongs to a person.
INTERACTIVE = ("cli", "exec", "vscode", "chatgpt", "atlas")


def sha256_of(*parts: Column | str) -> Column:
    """SHA-256 of the parts with a zero byte between them."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.sha2(F.concat_ws(ZERO, *cols).cast("binary"), 256)


def little_endian_u64(value: Column) -> Column:
    """The eight bytes of a number, lowest first."""
    hexes = F.lpad(F.hex(value), 16, "0")
    return F.unhex(F.concat(*(F.substring(hexes, 15 - 2 * i, 2) for i in range(8))))


def is_uuid(text: Column) -> Column:
    return text.rlike(f"^{UUID}$")


def rollout_id(file_name: Column) -> Column:
    """The id in rollout-<19 characters>-[...]<uuid>.jsonl; null if there is none."""
    found = F.regexp_extract(file_name, rf"^rollout-.{{19}}-(?:.*_)?({UUID})\.jsonl$", 1)
    return F.when(found != "", found)


def session_of_path(path: Column) -> Column:
    """The nearest folder that is session_<id> or a bare UUID."""
    folders = F.reverse(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1))
    named = F.filter(folders, lambda d: d.startswith("session_") | is_uuid(d))
    return F.regexp_replace(F.get(named, F.lit(0)), "^session_", "")


def plain_model(model: Column) -> Column:
    """A model without the vendor's own prefix; null for none and for placeholders like __name__."""
    bare = F.regexp_replace(model, "^kimi-code/", "")
    return F.when((bare != "") & ~bare.rlike("^__.*__$"), bare)


def client_of(source: Column, originator: Column) -> Column:
    """Which client wrote a rollout, from its session source and originator."""
    editor = (originator.isNull() | (originator == "codex_vscode")) & (source == "vscode")
    return F.when(originator == "Codex Desktop", "codex-desktop").when(editor, "codex-vscode").otherwise("codex-cli")


def is_interactive(source: Column) -> Column:
    return source.isNull() | source.isin(*INTERACTIVE)


def fnv1a64(data: bytes, h: int = 0xCBF29CE484222325) -> int:
    """The 64-bit FNV-1a hash, for names of driver-side documents; h: that of what comes before."""
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & (2**64 - 1)
    return h


def locale_of(tag: str | None) -> str:
    """zh for any Chinese tag, en for everything else."""
    low = (tag or "").lower()
    return "zh" if low == "zh" or low.startswith(("zh-", "zh_")) else "en"
