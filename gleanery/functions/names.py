"""Predicates and classifiers of entry names, paths, sizes and bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ARCHIVE_NAMES, fold

# Extensions of asset files, and the folders that they lie in.
MEDIA = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tga", ".webp", ".ogg", ".wav", ".mp3", ".flac", ".ttf", ".otf", ".woff", ".woff2",
    ".vsh", ".fsh", ".glsl", ".shader", ".mcmeta", ".nbt", ".obj", ".mtl",
)
ASSET_FOLDERS = ("/assets/", "textures/", "sounds/", "models/", "shaders/", "/lang/", "font/")
# What a name's ending says about an entry.
NESTED_NAMES, NATIVE_NAMES, SCRIPT_NAMES = r"\.(jar|war)$", r"\.(dll|so|dylib)$", r"\.(bat|ps1|sh|exe|vbs)$"
# First bytes of known formats.
MAGIC = (
    ("89504E47", "png"), ("FFD8FF", "jpeg"), ("47494638", "gif"), ("4F676753", "ogg"), ("52494646", "riff"), ("504B0304", "zip"), ("504B0506", "empty zip"),
    ("1F8B", "gzip"), ("664C6143", "flac"), ("00010000", "ttf"), ("774F4646", "woff"), ("CAFEBABE", "class"), ("5D0000", "lzma"), ("4D5A", "pe"), ("7F454C46", "elf"), ("52617221", "rar"), ("425A68", "bzip2"),
)
# Characters that show as nothing.
INVISIBLE = r"[\u200B\u200C\u200D\u2060\uFEFF\u00AD\u180E\u034F]"
ENCRYPTED_FLAGS = 65  # bits 0 and 6


def is_archive_name(name: Column) -> Column:
    return fold(name).rlike(ARCHIVE_NAMES)


def in_recycle_bin(path: Column) -> Column:
    return fold(path).contains("$recycle.bin") | fold(path).contains("recycler")


def entry_kind(name: Column) -> Column:
    low = fold(name)
    return (
        F.when(low.rlike("/$"), "directory").when(low == "meta-inf/manifest.mf", "manifest").when(low.rlike(r"\.class$"), "class")
        .when(low.rlike(NESTED_NAMES), "nested").when(low.rlike(NATIVE_NAMES), "native").when(low.rlike(SCRIPT_NAMES), "script").otherwise("resource")
    )


def is_signature(name: Column) -> Column:
    return fold(name).rlike(r"^meta-inf/.*\.(rsa|dsa|ec|sf)$")


def magic_kind(hexadecimal: Column) -> Column:
    """The format that the first bytes, in hexadecimal, tell; the longest magic wins."""
    out = F.lit(None).cast("string")
    for magic, kind in sorted(MAGIC, key=lambda m: len(m[0])):
        out = F.when(hexadecimal.startswith(magic), kind).otherwise(out)
    return out


def mime_type(hexadecimal: Column, name: Column, text: Column) -> Column:
    """By magic, else by extension, else text if under a fifth of the first 4096 characters is unprintable."""
    from .text import unprintable

    by_magic = {"png": "image/png", "jpeg": "image/jpeg", "gif": "image/gif", "zip": "application/zip", "gzip": "application/gzip"}
    by_name = {"html?": "text/html", "txt": "text/plain", "json": "application/json", "xml": "application/xml", "png": "image/png", "jpe?g": "image/jpeg"}
    kind, magic, ext = magic_kind(hexadecimal), F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, mime in by_magic.items():
        magic = F.when(kind == k, mime).otherwise(magic)
    for k, mime in by_name.items():
        ext = F.when(fold(name).rlike(rf"\.{k}$"), mime).otherwise(ext)
    plain = F.when(unprintable(text, 4096) * 5 < F.least(F.length(text), F.lit(4096)), "text/plain").otherwise("application/octet-stream")
    return F.coalesce(magic, ext, plain)


def has_traversal(name: Column) -> Column:
    return name.contains("../") | name.contains("..\\") | name.startswith("/") | name.contains(":\\")


def is_odd_method(method: Column) -> Column:
    return ~method.isin(0, 8)


def is_extreme_ratio(packed: Column, size: Column) -> Column:
    return (packed > 512) & (F.floor(size / F.greatest(packed, F.lit(1))) > 1200)


def is_encrypted(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(ENCRYPTED_FLAGS)) != 0


def is_deceptive(name: Column) -> Column:
    """Holds control, format or unassigned characters, an unusual blank, or Latin mixed with Cyrillic or Greek."""
    mixed = name.rlike(r"\p{IsLatin}") & name.rlike(r"[\p{IsCyrillic}\p{IsGreek}]")
    return name.rlike(r"[\p{Cf}\p{Cc}\p{Cn}\p{Cs}]") | name.rlike(r"[\p{Z}&&[^ ]]") | mixed


def is_barcode(name: Column) -> Column:
    return name.rlike("^[Il1iO0o]{4,}$")


def has_invisible(name: Column) -> Column:
    return name.rlike(INVISIBLE)


def is_non_ascii(name: Column) -> Column:
    return name.rlike(r"[^\x00-\x7E]") & ~has_invisible(name)


def is_short(name: Column) -> Column:
    return (F.length(name) <= 2) & ~name.startswith("<")


def is_asset_path(path: Column) -> Column:
    """The game's own namespace, a language file, or a media file in an asset folder, whose extension may have up to three characters behind it."""
    low = fold(F.trim(path))
    own = low.startswith("assets/minecraft/") | low.contains("/assets/minecraft/")
    language = (low.startswith("lang/") | low.contains("/lang/")) & (low.contains(".json") | low.contains(".lang"))
    folder = low.startswith("assets/")
    for f in ASSET_FOLDERS:
        folder = folder | low.contains(f)
    media = F.lit(False)
    for ext in MEDIA:
        at = F.instr(low, F.lit(ext))
        media = media | low.endswith(ext) | ((at > 1) & (at + len(ext) + 2 >= F.length(low)))
    return own | language | (folder & media)


def is_plausible_path(path: Column) -> Column:
    """An absolute path of a drive or network share, of at least six characters, without shell punctuation, with an extension."""
    return (F.length(path) >= 6) & ~path.startswith("-") & path.rlike(r"^(.:[\\/]|\\\\)") & ~path.rlike("[$|><&*?\"'`]") & path.rlike(r"\.[^.\\/]+$")


def is_jvm_process(exe: Column) -> Column:
    return fold(F.regexp_extract(exe, r"[^\\/]+$", 0)).isin("java.exe", "javaw.exe")


def age_band(days: Column) -> Column:
    return F.when(days <= 1, "day").when(days <= 7, "week").when(days <= 30, "month").otherwise("older")


def score_band(score: Column) -> Column:
    return F.when(score >= 300, "high").when(score >= 120, "raised").when(score >= 40, "some").otherwise("low")


def mod_loader(name: Column) -> Column:
    """The loader that a metadata file is for; null for other names."""
    low = fold(name)
    return F.when(low == "fabric.mod.json", "Fabric").when(low.isin("mcmod.info", "meta-inf/mods.toml", "mods.toml"), "Forge").when(low.isin("plugin.yml", "bungee.yml"), "Bukkit/Spigot")


# How file names of well-known libraries begin, and packages that come with a platform.
LIBRARY_STARTS = (
    "guava-", "gson-", "jackson-", "commons-", "log4j-", "slf4j-", "asm-", "netty-", "kotlin-stdlib", "kotlinx-", "junit-", "mockito-", "hamcrest-", "javax.",
    "jopt-simple-", "jansi-", "jna-", "jffi-", "oshi-", "reactive-streams", "httpclient", "httpcore", "httpmime", "fluent-hc", "xercesImpl", "xml-apis",
    "dom4j-", "jaxen-", "snakeyaml-", "jzlib-", "akka-", "scala-", "protobuf-java", "grpc-", "protobuf-", "opencensus-", "perfidies-",
    "checker-qual-", "error_prone-", "j2objc-", "animal-sniffer-", "mozillaparser-", "rhino-", "nashorn-", "jline-", "jansi-", "lwjgl-", "lwjgl3-", "stb-",
    "joml-", "uncsimplelibs-", "brigadier-", "datafixerupper-", "authlib-", "launcher-", "fastutil-", "it.unimi", "trove4j-", "coreml-",
    "text2speech", "jlayer-", "tritonus-", "vorbisspi-", "mp3spi-", "com.sun", "sun.misc", "java-objc-", "native-utils-", "oshi-core", "libffi", "jctools-",
    "abstract-fixture", "testng-", "spock-core-", "groovy-", "minecraftforge", "fml", "forge-",
)
LIBRARY_ENDS = ("-sources.jar", "-javadoc.jar")
STANDARD_PACKAGES = (
    "java/", "javax/", "sun/", "com/sun/", "org/apache/", "com/google/", "com/mojang/", "net/minecraft/", "org/objectweb/", "org/jetbrains/", "com/intellij/",
    "org/junit/", "kotlin/", "kotlinx/", "org/slf4j/", "org/eclipse/", "org/gradle/", "com/github/", "javassist/", "net/sf/", "org/bouncycastle/",
)
# Signatures of calls that may turn a hidden text into a plain one, and owners that never do.
DECRYPT_DESCRIPTORS = (
    "(Ljava/lang/String;)Ljava/lang/String;", "(I)Ljava/lang/String;", "([C)Ljava/lang/String;", "(II)Ljava/lang/String;", "(J)Ljava/lang/String;", "([B)Ljava/lang/String;",
)
PLATFORM_OWNERS = ("java/", "javax/", "jdk/", "sun/")
GAME_WORDS = ("minecraft", "net.minecraft", "fabric", "forge", "lunar", "badlion", "prismlauncher", "multimc")


def _starts(text: Column, starts: tuple[str, ...]) -> Column:
    return text.rlike("^(" + "|".join(s.replace(".", r"\.") for s in starts) + ")")


def is_library_name(name: Column) -> Column:
    """A well-known library by its file's name, compared in lower case as it stands."""
    low = F.lower(name)
    return _starts(low, LIBRARY_STARTS) | low.endswith(LIBRARY_ENDS[0]) | low.endswith(LIBRARY_ENDS[1])


def is_standard_package(entry: Column) -> Column:
    return _starts(entry, STANDARD_PACKAGES)


def is_decrypt_call(owner: Column, descriptor: Column) -> Column:
    """A call with the signature of a text factory whose owner is known and not the platform's."""
    return F.coalesce(descriptor.isin(*DECRYPT_DESCRIPTORS) & ~_starts(owner, PLATFORM_OWNERS), F.lit(False))


def is_game_process(*texts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *texts)).rlike("|".join(w.replace(".", r"\.") for w in GAME_WORDS))


def read_outcome(classes: Column, read: Column) -> Column:
    """Whether an archive's classes could be read: none there, none readable, or scanned."""
    return F.when(classes == 0, "NO_CLASSES").when(read == 0, "FAILED").otherwise("POOL_SCANNED")


def read_summary(outcome: Column, read: Column, unreadable: Column) -> Column:
    """``-`` without classes, how many of all were read if some were not, else the outcome."""
    part = F.concat(read.cast("string"), F.lit(" / "), (read + unreadable).cast("string"))
    return F.when(outcome == "NO_CLASSES", "-").when((outcome == "POOL_SCANNED") & (unreadable > 0), part).otherwise(outcome)


def suspicion_reason(outcome: Column, encrypted: Column, obfuscated: Column, broken: Column, tool: Column) -> Column:
    """Why an archive is suspicious in a few words, the gravest reason first; empty if it isn't."""
    named = F.trim(F.coalesce(tool, F.lit("")))
    hidden = F.when((named == "") | (F.lower(named).isin("generic", "none")), "obfuscated").otherwise(F.concat(F.lit("obfuscated: "), named))
    return F.when(encrypted | (outcome == "ENCRYPTED"), "encrypted").when(obfuscated, hidden).when(outcome == "NOT_AN_ARCHIVE", "not an archive").when(broken | (outcome == "UNREADABLE"), "broken").otherwise("")


# Names that stay although they are short, or are known by their contract.
KEPT_NAMES = (
    "main", "toString", "equals", "hashCode", "clone", "getClass", "notify", "notifyAll", "wait", "finalize", "valueOf", "values", "ordinal", "name", "compareTo",
    "run", "start", "stop", "init", "close", "open", "read", "write", "size", "get", "set", "add", "remove", "put", "next", "hasNext", "iterator", "<init>", "<clinit>",
)


def says_nothing(name: Column) -> Column:
    """A name of one or two letters, digits, _ or $ that isn't known by its contract; only such names are replaced."""
    return F.coalesce(name.rlike(r"^[\p{L}\p{Nd}_$]{1,2}$") & ~name.isin(*KEPT_NAMES), F.lit(False))


# What a descriptor says about a method or a field, the first that fits.
METHOD_WORDS = (("Player", "handlePlayer"), ("Entity", "handleEntity"), ("World", "handleWorld"), ("Packet", "handlePacket"), ("Event", "onEvent"), ("ItemStack", "handleItem"), ("Block", "handleBlock"), ("Chat", "handleChat"), ("Message", "handleChat"))
FIELD_TYPES = (("Z", "flag"), ("I", "intField"), ("J", "longField"), ("D", "doubleField"), ("F", "floatField"), ("Ljava/lang/String;", "stringField"))
FIELD_STARTS = (("Ljava/util/List", "listField"), ("Ljava/util/Map", "mapField"), ("Ljava/util/Set", "setField"), ("L", "objectField"))


def stable_number(key: Column) -> Column:
    """A number below 100000 that depends on the key alone."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % 100000


# Flags of access, and what they say about a method whose descriptor says nothing.
PUBLIC, PRIVATE, PROTECTED, STATIC = 1, 2, 4, 8


def method_name(owner: Column, name: Column, descriptor: Column, access: Column | None = None) -> Column:
    """A telling name for a method whose own says nothing, out of its descriptor or else its access."""
    prefix = F.lit("method")
    if access is not None:
        has = lambda flag: access.bitwiseAND(F.lit(flag)) != 0
        prefix = F.when(has(PUBLIC) & ~has(STATIC), "publicMethod").when(has(PRIVATE), "privateMethod").when(has(PROTECTED), "protectedMethod").otherwise(prefix)
    for word, start in reversed(METHOD_WORDS):
        prefix = F.when(descriptor.contains(word), start).otherwise(prefix)
    return F.concat(prefix, stable_number(F.concat(owner, F.lit("."), name, descriptor)).cast("string"))


def field_name(owner: Column, name: Column, descriptor: Column) -> Column:
    prefix = F.lit("field")
    for start, word in reversed(FIELD_STARTS):
        prefix = F.when(descriptor.startswith(start), word).otherwise(prefix)
    for kind, word in FIELD_TYPES:
        prefix = F.when(descriptor == kind, word).otherwise(prefix)
    return F.concat(prefix, stable_number(F.concat(owner, F.lit("."), name, descriptor)).cast("string"))


def class_name(internal: Column, parent: Column, interface: Column | None = None) -> Column:
    """A name for a class out of its parent's or else its first interface's, if that says something, at most 20 characters of it."""
    def telling(of: Column) -> Column:
        simple = F.substring_index(of, "/", -1)
        return F.when(of.isNotNull() & (of != "java/lang/Object") & ~says_nothing(simple), F.left(simple, F.lit(20)))

    routes = [telling(parent), *([telling(interface)] if interface is not None else []), F.lit("Class")]
    return F.concat(F.lit("deobf/"), F.coalesce(*routes), stable_number(internal).cast("string"))


def renamed(name: Column, new: Column) -> Column:
    """The new name where the old one says nothing, else the old one."""
    return F.when(says_nothing(F.substring_index(name, "/", -1)), new).otherwise(name)
