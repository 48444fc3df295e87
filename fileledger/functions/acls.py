"""Access control lists as the kernel stores them, decoded by column expressions.

A blob is a version (4 bytes) and entries of 8 bytes: tag, permissions, id, all little-endian.
Rights are bits: 4 read, 2 write, 1 execute.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format: the tags of entries.
OWNER, USER, OWNING_GROUP, GROUP, MASK, OTHER = 1, 2, 4, 8, 16, 32
HEADER_BYTES, ENTRY_BYTES = 4, 8
ENTRIES = "array<struct<tag: int, perm: int, id: bigint>>"


def _number(blob: Column, at: Column, n: int) -> Column:
    byte = lambda k: F.conv(F.hex(F.substring(blob, at + k, F.lit(1))), 16, 10).cast("bigint")
    total = byte(0)
    for k in range(1, n):
        total = total + byte(k) * (1 << 8 * k)
    return total


def acl_entries(blob: Column) -> Column:
    """Entries (tag, perm, id) of a blob; no entries for null."""
    count = F.floor((F.octet_length(blob) - HEADER_BYTES) / ENTRY_BYTES)

    def entry(i: Column) -> Column:
        at = (i * ENTRY_BYTES + HEADER_BYTES + 1).cast("int")
        return F.struct(_number(blob, at, 2).cast("int").alias("tag"), _number(blob, at + 2, 2).cast("int").alias("perm"), _number(blob, at + 4, 4).alias("id"))

    none = F.array().cast(ENTRIES)
    return F.when(blob.isNull() | (count < 1), none).otherwise(F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), entry))


def perm_of(entries: Column, tag: int) -> Column:
    """The permissions of the only entry of a tag; null if there is none."""
    return F.try_element_at(F.filter(entries, lambda e: e["tag"] == tag), F.lit(1))["perm"]


def named(entries: Column) -> Column:
    """(tag, id) of the users and groups that have entries of their own."""
    return F.transform(F.filter(entries, lambda e: e["tag"].isin(USER, GROUP)), lambda e: F.struct(e["tag"].alias("tag"), e["id"].alias("id")))


def rights(entries: Column, mode: Column, tag: Column, id_: Column, mode_rules: bool = False) -> Column:
    """What a user or group by name (tag, id), the owning group or all others may do: entries under the mask, or the mode where there are none.

    mode_rules: a mode has been set after the entries, so that its group bits are the mask and its
    last bits the rights of others.  A user or group without an entry has the rights of others.
    """
    group_bits, other_bits = F.shiftright(mode, 3).bitwiseAND(7), mode.bitwiseAND(7)
    listed = F.size(entries) > 0
    long = F.size(F.filter(entries, lambda e: e["tag"].isin(USER, GROUP, MASK))) > 0
    mask = F.when(long, group_bits if mode_rules else F.coalesce(perm_of(entries, MASK), F.lit(7))).otherwise(7)
    group = F.when(~listed, group_bits).when(long | F.lit(not mode_rules), F.coalesce(perm_of(entries, OWNING_GROUP), group_bits)).otherwise(group_bits)
    other = F.when(listed & F.lit(not mode_rules), F.coalesce(perm_of(entries, OTHER), other_bits)).otherwise(other_bits)
    own = F.try_element_at(F.filter(entries, lambda e: (e["tag"] == tag) & (e["id"] == id_)), F.lit(1))["perm"]
    return F.when(tag.isin(USER, GROUP), F.coalesce(own.bitwiseAND(mask), other)).when(tag == OWNING_GROUP, group.bitwiseAND(mask)).otherwise(other)


def rights_text(bits: Column) -> Column:
    """rwx, r--, ..."""
    one = lambda bit, letter: F.when(bits.bitwiseAND(bit) > 0, letter).otherwise("-")
    return F.concat(one(4, "r"), one(2, "w"), one(1, "x"))


def principal_text(tag: Column, id_: Column) -> Column:
    return F.when(tag == USER, F.concat(F.lit("user:"), id_)).when(tag == GROUP, F.concat(F.lit("group:"), id_)).when(tag == OWNING_GROUP, "group").otherwise("other")
