"""Codes of the on-disk format."""

#: attribute types by slot (fixed values): type = 0x10 * (slot + 1)
ATTRIBUTES = (
    "STANDARD_INFORMATION",
    "ATTRIBUTE_LIST",
    "FILE_NAME",
    "OBJECT_ID",
    "SECURITY_DESCRIPTOR",
    "VOLUME_NAME",
    "VOLUME_INFORMATION",
    "DATA",
    "INDEX_ROOT",
    "INDEX_ALLOCATION",
    "BITMAP",
    "REPARSE_POINT",
    "EA_INFORMATION",
    "EA",
    "PROPERTY_SET",
    "LOGGED_UTILITY_STREAM",
)
TYPE = {name: 0x10 * (i + 1) for i, name in enumerate(ATTRIBUTES)}
END_OF_ATTRIBUTES = 0xFFFFFFFF
MASK_ALL = (1 << len(ATTRIBUTES)) - 1

#: record flags, index entry flags, attribute flags (fixed values)
IN_USE, IS_DIRECTORY = 1, 2
SUBNODE, LAST = 1, 2
COMPRESSED_ATTRIBUTE, ENCRYPTED_ATTRIBUTE, SPARSE_ATTRIBUTE = 0x0001, 0x4000, 0x8000

#: permission bits of STANDARD_INFORMATION and FILE_NAME (fixed values)
READONLY, HIDDEN, SYSTEM, ARCHIVE, DEVICE, NORMAL, TEMPORARY = 0x1, 0x2, 0x4, 0x20, 0x40, 0x80, 0x100
SPARSE, REPARSE, COMPRESSED, OFFLINE, NOT_INDEXED, ENCRYPTED = 0x200, 0x400, 0x800, 0x1000, 0x2000, 0x4000
NAME_DIRECTORY, NAME_INDEX_VIEW = 0x10000000, 0x20000000

#: name spaces (fixed values)
POSIX, WIN32, DOS, WIN32_AND_DOS = 0, 1, 2, 3

#: well-known records (fixed values); the first record that users make
MFT, MFT_MIRROR, LOG_FILE, VOLUME, ATTR_DEF, ROOT, BITMAP_FILE, BOOT, BAD_CLUSTERS, SECURE, UPCASE, EXTEND = range(12)
FIRST_USER = 16

#: low 48 bits of a file reference; the other 16 are a sequence number
REFERENCE_MASK = (1 << 48) - 1
#: ticks of 100 ns between 1601 and 1970
EPOCH_TICKS = 116_444_736_000_000_000
