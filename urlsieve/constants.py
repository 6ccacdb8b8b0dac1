"""Fixed values. These have to equal the published ones for results to agree;
nothing here is logic."""

NORMALIZATION_VERSION = "v1-strip-scheme-www-lower"

# Risk weight of a top-level label; any other label weighs 0.1.
TLD_RISK = {
    "cc": 0.85, "xyz": 0.90, "top": 0.90, "ru": 0.70, "cn": 0.70, "tk": 0.95,
    "ml": 0.95, "ga": 0.95, "cf": 0.95, "gq": 0.95, "click": 0.85, "club": 0.75,
    "work": 0.80, "link": 0.75, "buzz": 0.85, "fit": 0.80, "info": 0.65,
    "cam": 0.85, "icu": 0.90, "monster": 0.85, "live": 0.60,
}
DEFAULT_TLD_RISK = 0.1

# Brand names; the position is the tie-break of the brand match.
BRANDS = [
    "paypal", "microsoft", "google", "apple", "amazon", "netflix", "chase",
    "facebook", "instagram", "wellsfargo", "bankofamerica", "binance", "coinbase",
    "ebay", "walmart", "citibank", "usps", "dhl", "fedex", "dropbox", "adobe",
    "linkedin", "twitter", "yahoo", "roblox", "steam", "metamask", "barclays",
    "hsbc", "github", "gitlab", "wikipedia", "stackoverflow", "reddit", "spotify",
    "youtube", "zoom", "salesforce", "cloudflare",
]

# Intent keywords, counted as substrings (overlaps both count).
KEYWORDS = [
    "login", "signin", "verify", "verification", "bank", "account", "update",
    "secure", "security", "wallet", "confirm", "confirmation", "auth",
    "authenticate", "support", "alert", "billing", "service", "recovery", "portal",
    "validation", "validate", "password", "passcode", "suspend", "suspended",
    "unlock", "unusual", "activity", "id-verify",
]

# The characters counted by special_char_count.
SPECIAL_CHARS = "-_.@?=&%+!~$#;:"

# Second-level labels that act as public suffixes (co.uk, com.au).
SECOND_LEVEL_SUFFIXES = ["co", "com", "net", "org", "gov", "edu", "ac", "or", "ne", "go"]

# Host labels never compared with a brand.
COMMON_TLDS = [
    "com", "org", "net", "edu", "gov", "mil", "int", "io", "co", "ai", "app", "dev",
    "uk", "ca", "de", "jp", "fr", "au", "in", "ru", "cn", "cc", "xyz", "top", "tk",
    "ml", "ga", "cf", "gq", "click", "club", "work", "link", "buzz", "fit", "info",
    "cam", "icu", "monster", "live", "online", "site", "us", "me", "tv", "biz", "pro",
]

# The order of the feature vector.
FEATURE_NAMES = [
    "url_length", "hostname_length", "path_length", "query_length",
    "subdomain_count", "path_depth", "digit_count", "digit_ratio",
    "uppercase_count", "uppercase_ratio", "special_char_count", "dot_count",
    "hyphen_count", "slash_count", "at_count", "question_count", "equal_count",
    "shannon_entropy", "vowel_consonant_ratio", "is_ip_address", "is_punycode",
    "suspicious_keyword_count", "tld_risk_score", "min_brand_levenshtein_distance",
    "is_homoglyph_brand", "has_brand_in_subdomain_or_path",
    "is_authentic_brand_domain", "consecutive_char_repeat_count",
    "avg_word_length", "char_trigram_diversity",
]

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Cell texts that the usual CSV loader reads as missing.
CSV_NULLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Experts and weights of the two blends, and the tuning limits.
BLEND_CHAMPION = {"p_hyb": 0.50, "p_nn": 0.30, "p_nlp": 0.20}
BLEND_SERVING = {"p_nlp": 0.45, "p_hyb": 0.55}
MAX_FPR = 0.015
DEFAULT_THRESHOLD = 0.50
BARE_DOMAIN_FRACTION = 0.5

# Hand-labelled urls of the out-of-corpus check (0 benign, 1 malicious).
SMOKE_URLS = [
    ("google.com", 0),
    ("wikipedia.org", 0),
    ("github.com", 0),
    ("sbi.co.in", 0),
    ("https://github.com/torvalds/linux", 0),
    ("https://www.bbc.co.uk/news/world-us-canada-12345", 0),
    ("https://stackoverflow.com/questions/1234/how-to-parse-json", 0),
    ("https://en.wikipedia.org/wiki/Machine_learning", 0),
    ("https://www.amazon.com/dp/B08N5WRWNW", 0),
    ("https://accounts.google.com/signin/v2/identifier", 0),
    ("https://login.microsoftonline.com/common/oauth2/authorize", 0),
    ("https://www.paypal.com/us/signin", 0),
    ("https://mail.google.com/mail/u/0/", 0),
    ("https://www.reddit.com/r/programming/comments/abc123/", 0),
    ("https://news.ycombinator.com/item?id=38912345", 0),
    ("https://docs.python.org/3/library/os.path.html", 0),
    ("https://www.irs.gov/payments", 0),
    ("https://www.linkedin.com/in/some-person-1234", 0),
    ("https://drive.google.com/file/d/1a2b3c/view", 0),
    ("https://amazon.com.security-update.ru/signin", 1),
    ("http://192.168.1.1/paypal/login/verify.php", 1),
    ("http://paypa1-secure-login.tk/account/verify", 1),
    ("https://appleid.apple.com.verify-account.xyz/login", 1),
    ("http://xn--80ak6aa92e.com/signin", 1),
    ("http://secure-chase-bank.verify-now.top/update/billing", 1),
    ("http://netflix-billing-update.gq/account/payment", 1),
    ("https://microsoft-office365-login.duckdns.org/auth", 1),
    ("http://wellsfargo.com-secure-id.cf/login.htm", 1),
    ("http://192.0.2.44:8080/wp-includes/paypal/websc.php", 1),
    ("https://binance-giveaway-claim.click/wallet/connect", 1),
    ("http://dhl-parcel-tracking-redelivery.buzz/pay", 1),
    ("http://gooogle-account-recovery.icu/signin", 1),
    ("https://update-your-account-info-now.monster/verify/id", 1),
    ("http://facebook.security-check.ml/login.php", 1),
]
