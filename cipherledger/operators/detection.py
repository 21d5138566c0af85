"""Text detection: content against rule tables, and which files are looked at at all.

Rules are data. Each rule's expression is a literal column expression, so it is compiled once and runs
inside generated code; a file without any mark of the prefilter is dropped before it is cut into lines.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherledger.functions.scale import spread
from cipherledger.functions.text import plain_path


@dataclass(frozen=True)
class Rule:
    """A text rule; alternatives are matched as whole words unless `anywhere`."""

    name: str
    raw_type: str
    detected: str
    alternatives: str
    key: str | None = None
    default_key: int | None = None
    curve: str | None = None
    mode: str | None = None
    default_mode: str | None = None
    anywhere: bool = False
    anchors: tuple[str, ...] = ()  #: texts in lower case of which every match holds one; looked for before the expression is tried

    def regex(self) -> str:
        return self.alternatives if self.anywhere else rf"(?i)(?<!\w)({self.alternatives})(?!\w)"


# The 15 text rules and the prefilter.
Q = "[\"']"
_KEY3 = r"(?i)(?<!\w)(128|192|256)(?!\w)"
_KEYR = r"(?i)(?<!\w)(?:key_size|bits|length|keysize)\s*[:=]\s*(\d{3,5})(?!\w)|(?<!\w)(1024|2048|3072|4096)(?!\w)"
_CURVES = r"(?i)(?<!\w)(secp256r1|secp256k1|prime256v1|secp384r1|secp521r1|ed25519|x25519|ed448|x448|p-256|p-384|p-521)(?!\w)"
RULES = [
    Rule("RSA Algorithm", "algorithm", "RSA", rf"RSA(?:_PKCS1_OAEP|_PKCS1_v1_5|_PSS)?|generate_private_key\s*\(\s*(?:algorithm\s*=\s*)?rsa|RSA\.generate|KeyPairGenerator\.getInstance\s*\(\s*{Q}RSA{Q}|crypto\.generateKeyPair(?:Sync)?\s*\(\s*{Q}rsa{Q}", key=_KEYR, default_key=2048, anchors=("rsa",)),
    Rule("ECC / ECDSA / ECDH", "algorithm", "ECC", r"ECDSA|ECDH|Ed25519|X25519|Ed448|X448|secp256r1|secp256k1|secp384r1|secp521r1|prime256v1|NIST256p|P-256|P-384|P-521|EllipticCurve|ECKey", curve=_CURVES, anchors=("ecdsa", "ecdh", "25519", "d448", "x448", "secp", "prime256v1", "nist256p", "p-256", "p-384", "p-521", "ellipticcurve", "eckey",)),
    Rule("Diffie-Hellman / DSA", "algorithm", "Diffie-Hellman", rf"DiffieHellman|DHParameterSpec|KeyPairGenerator\.getInstance\s*\(\s*{Q}DSA{Q}|KeyPairGenerator\.getInstance\s*\(\s*{Q}DH{Q}", default_key=2048, anchors=("diffiehellman", "dhparameterspec", "keypairgenerator",)),
    Rule("AES Symmetric Cipher", "algorithm", "AES", rf"AES(?:-128|-192|-256)?(?:-CBC|-GCM|-CTR|-ECB|-CFB|-OFB)?|AES\.new|Cipher\.getInstance\s*\(\s*{Q}AES[/\w-]*{Q}|crypto\.createCipheriv\s*\(\s*{Q}aes-(?:128|192|256)-(?:gcm|cbc|ctr|ecb){Q}", key=_KEY3, default_key=256, mode=r"(?i)(?<!\w)(GCM|CBC|CTR|ECB|CFB|OFB)(?!\w)", anchors=("aes",)),
    Rule("Legacy Weak Cipher (DES / 3DES / RC4 / Blowfish)", "algorithm", "Legacy-Cipher", rf"DESede|TripleDES|3DES|DES\.new|ARC4|RC4|Blowfish|Cipher\.getInstance\s*\(\s*{Q}(?:DES|DESede|RC4|Blowfish)[/\w-]*{Q}", default_key=56, mode=r"(?i)(?<!\w)(CBC|ECB|OFB|CFB)(?!\w)", anchors=("desede", "tripledes", "3des", "des.new", "rc4", "blowfish", "cipher.getinstance",)),
    Rule("ChaCha20-Poly1305 Cipher", "algorithm", "ChaCha20-Poly1305", r"ChaCha20(?:-Poly1305)?|chacha20_poly1305", default_key=256, default_mode="Poly1305", anchors=("chacha20",)),
    Rule("Broken Classical Hash (MD5 / SHA-1)", "algorithm", "MD5/SHA-1", rf"hashlib\.md5|hashlib\.sha1|MessageDigest\.getInstance\s*\(\s*{Q}(?:MD5|SHA-1|SHA1){Q}|crypto\.createHash\s*\(\s*{Q}(?:md5|sha1){Q}|MD5_Init|SHA1_Init", anchors=("md5", "sha1", "sha-1",)),
    Rule("Secure Hash (SHA-256 / SHA-384 / SHA-512 / SHA-3)", "algorithm", "SHA-2/SHA-3", rf"hashlib\.sha256|hashlib\.sha384|hashlib\.sha512|hashlib\.sha3_\w+|MessageDigest\.getInstance\s*\(\s*{Q}(?:SHA-256|SHA-384|SHA-512|SHA3-256|SHA3-512){Q}|crypto\.createHash\s*\(\s*{Q}(?:sha256|sha384|sha512){Q}|SHA256_Init|SHA512_Init", anchors=("sha256", "sha384", "sha512", "sha3", "sha-256", "sha-384", "sha-512",)),
    Rule("Post-Quantum Cryptographic Algorithm", "algorithm", "PQC-FIPS", r"ML-KEM(?:-512|-768|-1024)?|Kyber(?:512|768|1024)?|ML-DSA(?:-44|-65|-87)?|Dilithium(?:2|3|5)?|SLH-DSA|SPHINCS\+|Falcon(?:-512|-1024)?|FIPS\s*203|FIPS\s*204|FIPS\s*205|liboqs|oqs\.KeyExchange|oqs\.Signature", anchors=("ml-kem", "kyber", "ml-dsa", "dilithium", "slh-dsa", "sphincs+", "falcon", "fips", "oqs",)),
    Rule("Hybrid Classical + Post-Quantum Scheme", "algorithm", "Hybrid-PQC", r"X25519Kyber768Draft00|X25519MLKEM768|SecP256r1MLKEM768|HybridKeyExchange|hybrid_kem|dual_algorithm_signature", anchors=("x25519kyber768draft00", "mlkem768", "hybridkeyexchange", "hybrid_kem", "dual_algorithm_signature",)),
    Rule("Hardcoded Private Key / PEM", "key", "Hardcoded-Private-Key", r"(-----BEGIN (?:RSA|EC|DSA|OPENSSH|ENCRYPTED)? ?PRIVATE KEY-----)", anywhere=True, anchors=("private key-----",)),
    Rule("Hardcoded X.509 Certificate", "certificate", "X509-Certificate", r"(-----BEGIN CERTIFICATE-----)", anywhere=True, anchors=("-----begin certificate-----",)),
    Rule("Cryptographic Protocol (TLS / SSL / SSH / IPsec)", "protocol", "TLS/SSL Protocol", r"SSLv2|SSLv3|TLSv1|TLSv1\.0|TLSv1\.1|TLSv1\.2|TLSv1\.3|PROTOCOL_TLSv1|PROTOCOL_SSLv23|ssl\.PROTOCOL_TLS_CLIENT|ssl\.PROTOCOL_TLS_SERVER|OpenSSL::SSL::SSLContext|tls\.Config", anchors=("sslv2", "sslv3", "sslv23", "tlsv1", "protocol_tls", "sslcontext", "tls.config",)),
    Rule("Cloud Key Management Service", "cloud_service", "Cloud KMS Service", rf"boto3\.client\s*\(\s*{Q}kms{Q}|aws_kms|kmsClient\.encrypt|kmsClient\.decrypt|SecretClient|KeyVaultClient|cloudkms\.googleapis\.com|hashicorp/vault|vault\.read|vault\.write", anchors=("kms", "secretclient", "keyvaultclient", "vault",)),
    Rule("Hardware Security Module / PKCS#11 / TPM", "hardware_module", "HSM/PKCS#11 Module", r"pkcs11|PyKCS11|libsofthsm2|C_Initialize|C_OpenSession|C_Sign|YubiHSM|tpm2_create|TPM2_CC_Encrypt|SunPKCS11|LunaProvider", anchors=("pkcs11", "libsofthsm2", "c_initialize", "c_opensession", "c_sign", "yubihsm", "tpm2_", "lunaprovider",)),
]
PREFILTER = (
    r"(?i)(rsa|ecdsa|ecdh|ed25519|x25519|secp|prime256|curve|diffie|dhparam|aes|des|rc2|rc4|blowfish|idea|chacha|poly1305|salsa"
    r"|md5|sha1|sha-1|sha2|sha256|sha384|sha512|sha3|blake|cipher|crypto|encrypt|decrypt|sign|digest|hmac|hash"
    r"|kyber|dilithium|falcon|sphincs|ml-kem|ml-dsa|slh-dsa|liboqs|oqs|tls|ssl|pkcs|pkcs11|hsm|keystore|keyvault|kms|vault|-----BEGIN|private_key|publickey|certificate)"
)


#: A line without any of the rules' anchors matches no rule.
ANCHORS = list(dict.fromkeys(a for r in RULES for a in r.anchors))


def _holds(anchors: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.col("_low"), F.lit(x)) for x in anchors])


def _first(text: Column, regex: str) -> Column:
    return F.regexp_extract(text, regex, 1)


def detect(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_number, rule, raw_type, detected_name, matched, key_length, curve_name, mode, snippet.

    The first match of each rule on each line of each text; lines end at LF, CR LF or CR and count from 1.
    Key length: the rule's expression on that line, else its default; curve and mode likewise in
    upper case. Snippets are the trimmed line's first 200 characters. Null and empty texts yield nothing;
    repeated rows yield repeated matches.
    """
    ends = r"\r\n|\n|\r"
    # lines and their lower case come from one array, so neither is computed again for each anchor
    cut = spread(texts.select(key, text)).filter(F.col(text).rlike(PREFILTER)).select(F.col(key), F.posexplode(F.arrays_zip(F.split(F.col(text), ends).alias("line"), F.split(F.lower(text), ends).alias("low"))).alias("_at", "_both"))
    some = cut.select(key, "_at", F.col("_both.line").alias("_line"), F.col("_both.low").alias("_low")).filter(_holds(ANCHORS))
    line = F.col("_line")
    found = []
    for r in RULES:
        matched = _first(line, r.regex())
        size = F.lit(None).cast("int")
        if r.key:
            groups = [F.regexp_extract(line, r.key, g).try_cast("int") for g in range(1, 3 if r.key == _KEYR else 2)]
            size = F.coalesce(*groups)
        size = F.coalesce(size, F.lit(r.default_key).cast("int"))
        mode = F.upper(_first(line, r.mode)) if r.mode else F.lit(r.default_mode or "")
        curve = F.upper(_first(line, r.curve)) if r.curve else F.lit("")
        value = F.struct(F.lit(r.name).alias("rule"), F.lit(r.raw_type).alias("raw_type"), F.lit(r.detected).alias("detected_name"), matched.alias("matched"), size.alias("key_length"), F.when(curve != "", curve).alias("curve_name"), F.when(mode != "", mode).alias("mode"))
        found.append(F.when(_holds(r.anchors) & (matched != ""), value))
    hits = some.select(key, (F.col("_at") + 1).alias("line_number"), F.substring(F.trim(line), 1, 200).alias("snippet"), F.explode(F.array_compact(F.array(*found))).alias("_hit"))
    return hits.select(key, "line_number", "_hit.*", "snippet")


# Directories, names and endings that a walk leaves out; what each scanner takes.
SKIPPED_DIRS = [
    "node_modules", "bower_components", "jspm_packages", "vendor", "site-packages", "dist-packages", "packages", ".git", ".hg", ".svn", ".bzr", ".idea", ".vscode", ".vs",
    "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".nox", "venv", ".venv", "env", ".env.d", "virtualenv", "build", "dist", "out", "target", "bin", "obj",
    ".next", ".nuxt", ".svelte-kit", ".parcel-cache", ".turbo", ".gradle", "cmake-build-debug", "data_store", "design-system", ".cache", ".terraform", "coverage", "htmlcov",
]
KEPT_HIDDEN = [".github", ".gitlab", ".circleci"]
SKIPPED_NAMES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "npm-shrinkwrap.json", "poetry.lock", "pipfile.lock", "cargo.lock", "composer.lock", "gemfile.lock", "go.sum", "flake.lock"]
SKIPPED_ENDS = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".webp", ".svg", ".avif", ".mp3", ".mp4", ".avi", ".mov", ".wav", ".flac", ".webm", ".mkv", ".zip", ".tar", ".gz", ".bz2", ".xz",
    ".7z", ".rar", ".iso", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".ttf", ".otf", ".woff", ".woff2", ".eot", ".pyc", ".pyo", ".pyd", ".map", ".min.js", ".min.css",
]
SOURCE_ENDS = ["py", "js", "ts", "jsx", "tsx", "java", "c", "cpp", "h", "hpp", "go", "rs", "cs", "php", "rb", "kt", "swift", "scala", "env", "json", "yaml", "yml"]
MANIFESTS = ["package.json", "requirements.txt", "pipfile", "pom.xml", "go.mod", "cargo.toml"]
MOST_BYTES = 8 * 1024 * 1024
MOST_DEPTH = 25


def listing(files: DataFrame) -> DataFrame:
    """file_id, scan_id, path, extension, depth, verdict, scanners of each listed file.

    verdict is the first that holds of: pruned (a directory on the way is left out, or is too deep),
    skipped_type (name or ending), skipped_size (above MOST_BYTES), scanned. scanners are those that take
    a scanned file, in order; a file may feed several. Repeated rows count once. Null paths are left out.
    """
    f = files.filter("file_path is not null").select("file_id", "scan_id", "size_bytes", plain_path(F.col("file_path")).alias("path")).dropDuplicates(["file_id"])
    parts = F.split(F.lower("path"), "/")
    dirs, name = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, -1)
    bad_dir = F.exists(dirs, lambda d: d.isin(SKIPPED_DIRS) | (F.startswith(d, F.lit(".")) & ~d.isin(KEPT_HIDDEN)) | F.endswith(d, F.lit(".egg-info")))
    ends = F.lit(False)
    for e in SKIPPED_ENDS:
        ends = ends | F.endswith(name, F.lit(e))
    bad_name = name.isin(SKIPPED_NAMES) | (F.startswith(name, F.lit("scan_")) & F.endswith(name, F.lit(".json"))) | ends
    extension = F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise("")
    verdict = F.when(bad_dir | (F.size(dirs) >= MOST_DEPTH), "pruned").when(bad_name, "skipped_type").when(F.col("size_bytes") > MOST_BYTES, "skipped_size").otherwise("scanned")
    scanners = F.array(F.when(extension.isin(SOURCE_ENDS) | F.startswith(name, F.lit(".env")), "source"), F.when(name.isin(MANIFESTS), "dependency"), F.when(F.startswith(name, F.lit("dockerfile")), "container"))
    return f.withColumns({"extension": extension, "depth": F.size(dirs), "verdict": verdict}).select("file_id", "scan_id", "path", "extension", "depth", "verdict", F.when(F.col("verdict") == "scanned", F.array_compact(scanners)).otherwise(F.array().cast("array<string>")).alias("scanners"))


def coverage(files: DataFrame) -> DataFrame:
    """Per scan: files seen, scanned and skipped, by reason."""
    rows = listing(files)
    return rows.groupBy("scan_id").agg(F.count("*").alias("seen"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("scanned", "pruned", "skipped_type", "skipped_size")])


# Which scanners a target of each type is given to, in order.
ROUTES = [("source_code", "source", 1), ("source_code", "certificate", 5), ("binary", "binary", 2), ("dependency", "dependency", 3), ("container", "container", 4)]
ROUTES += [("multi_target", scanner, seq) for scanner, seq in (("source", 1), ("binary", 2), ("dependency", 3), ("container", 4), ("certificate", 5))]


def routed(scans: DataFrame) -> DataFrame:
    """scan_id, scanner, seq: the scanners that a scan runs, by its target types; a scanner runs once for each scan.

    Unknown types are routed nowhere; scans without types, and repeated rows, add nothing.
    """
    routes = scans.sparkSession.createDataFrame(ROUTES, "target_type string, scanner string, seq int")
    types = scans.filter("scan_id is not null").select("scan_id", F.explode("target_types").alias("target_type")).distinct()
    return types.join(routes, "target_type").groupBy("scan_id", "scanner").agg(F.min("seq").alias("seq"))
