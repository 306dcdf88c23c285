"""Term lists and patterns of the disclosure classifier.

Patterns are case-insensitive and use ASCII classes, so that other engines read
them alike.  They are made from plain words by the small grammar below: ``verb``
and ``noun`` inflect, ``phrase`` puts alternatives one after the other.  Which words stand in
a group follows from what the group means in the taxonomies of privacy policies
(Wilson et al., "The creation and analysis of a website privacy policy corpus",
ACL 2016) and in the public specifications of the registries.
"""

from __future__ import annotations


def any_of(*terms: str) -> str:
    """Case-insensitive pattern for whole words or phrases."""
    return r"(?i)\b(?:" + "|".join(terms) + r")\b"


def one_of(words: str) -> str:
    """Alternation over words."""
    return "(?:" + "|".join(words.split()) + ")"


def noun(word: str) -> str:
    """Singular and plural."""
    if word.endswith("y") and word[-2] not in "aeiou":
        return word[:-1] + "(?:y|ies)"
    return word + ("(?:es)?" if word.endswith(("s", "x", "ch", "sh")) else "s?")


def nouns(words: str) -> str:
    """Alternation over nouns in both numbers."""
    return "(?:" + "|".join(noun(w) for w in words.split()) + ")"


def verb(word: str) -> str:
    """Base form, third person, past and -ing form of a regular verb; "x" doubles where the base says so ("transfer+")."""
    if word.endswith("+"):
        w = word[:-1]
        return f"{w}(?:s|{w[-1]}ed|{w[-1]}ing)?"
    if word.endswith("e"):
        return word[:-1] + "(?:e|es|ed|ing)"
    return word + "(?:s|ed|ing)?"


def verbs(words: str) -> str:
    """Alternation over verbs in all forms."""
    return "(?:" + "|".join(verb(w) for w in words.split()) + ")"


def phrase(*parts: str) -> str:
    """Parts one after the other, with white space between them."""
    return r"\s+".join(parts)


_GAP = r"[- ]?"
_THIRD = rf"(?:third|3rd){_GAP}(?:part(?:y|ies))"
_FIRM = nouns("company business organisation organization entity firm")

# Recipients told apart by what they do: a line of business with a word for a firm in it, or one word for both.
_TRADES = {
    "advertising advertisement ad marketing": "partner network company service provider vendor agency platform server exchange",
    "analytics measurement": "provider partner company service vendor platform house",
    "data": "broker partner provider aggregator processor",
    "payment card transaction billing credit[-\\s]?card": "processor gateway provider handler service",
    "cloud hosting storage": "provider vendor service",
    "business marketing trusted strategic distribution commercial": "partner",
    "credit": "bureau reference",
    "shipping delivery logistics": "company partner provider",
}
CATEGORY = any_of(
    *[phrase(one_of(a), nouns(b)) for a, b in _TRADES.items()],
    rf"ad{_GAP}tech\s+" + nouns("partner vendor company"),
    rf"(?:{_THIRD}\s+)?service\s+providers?",
    phrase("cloud", "(?:hosting|storage)"),
    phrase("social", "(?:media|networks?|networking)") + rf"(?:\s+{nouns('site platform service provider')})?",
    phrase("credit", "reporting", nouns("agency")),
    phrase("law", "enforcement"),
    rf"governments?(?:\s+{nouns('agency body authority')})?",
    rf"sub{_GAP}" + nouns("processor contractor"),
    nouns("advertiser partner affiliate subsidiary vendor contractor supplier agent merchant reseller licensee sponsor publisher insurer auditor"),
)

# Recipients that aren't told apart.
GENERIC = any_of(
    _THIRD,
    "others",
    phrase("(?:other|outside|external|unaffiliated|unrelated|selected|separate)", "(?:" + "|".join([_FIRM, "part(?:y|ies)"]) + ")"),
    phrase("external", nouns("agency body")),
)

# Giving and taking of data.
SHARING = any_of(
    verbs("share disclose release divulge transfer+ forward"),
    "disclosure",
    phrase(verb("provide"), "(?:to|with)"),
    phrase(verb("make"), "available"),
    phrase("(?:grants?|gives?|allows?)", "access"),
    phrase("(?:we|us|our|they)", r"(?:also\s+)?(?:work|cooperate)", "with"),
    phrase(verb("partner"), "with"),
    phrase("(?:pass(?:es|ed|ing)?|hand(?:s|ed|ing)?)", "(?:on|over)"),
)
COLLECTION = any_of(
    verbs("collect track gather obtain receive capture"),
    phrase(verb("serve"), r"(?:ads|advertis\w+)"),
    phrase("(?:" + "|".join([verb("place"), verb("use"), "sets?", "setting"]) + ")", "cookies"),
    phrase(verb("use"), rf"(?:(?:tracking|similar)\s+)?(?:{nouns('pixel beacon sdk')}|web\s+beacons?|technolog\w+)"),
)
SALE = rf"(?i)\b(?:sells?|selling|sold|{verb('rent')}|{verb('trade')})\b[^.;:!?]{{0,60}}?\b(?:data|information|records)\b"
SALE_STOPPED = rf"(?i)\b(?:stop(?:s|ped)?|{verb('cease')}|{verb('end')}|discontinu\w+)\s+$"

# Negation, its exceptions and what ends a clause; the windows are fixed values.
NEGATION = r"(?i)\b(?:not|no longer|never|neither|nor|without|cannot|(?:do|does|did|wo|ca|will)n't|refrains? from|declines? to)\b"
EXCEPTION = r"(?i)\b(?:except|unless|other than|apart from|aside from|with the exception of|save (?:for|that|as|where|to the extent))\b"
CLAUSE_END = r"(?is)^.*(?:[.;!?:] |,\s*(?:" + "|".join("but however yet though although whereas".split()) + r")\b\s*)"
SELF_RECIPIENT = r"(?i)^\s*(?:(?:with|to)\s+)?(?:us|you)\b"
NO_SUCH = r"(?i)\bno\s+(?:\w+\s+)?$"
NEGATION_WINDOW, EXCEPTION_WINDOW, COLLECTS_WINDOW, PARTY_WINDOW = 45, 140, 90, 70

# Who speaks, about what, and by which means.
_SITE = nouns("site website app application service page")
FIRST_PARTY = rf"(?i)\b(?:we|us|our)\b|\b(?:the|this)\s+{_SITE}\b"
DATA_NOUN = any_of("data", "information", "personal", "browsing", "tracking", "usage", "analytics", nouns("cookie identifier pixel beacon tracker record"))
_TRACKER = "(?:" + "|".join([nouns("cookie tag tracker script sdk"), r"pixel(?:s|\s+tags?)?", r"web\s+beacons?", r"technolog\w+"]) + ")"
_PUT = "(?:" + "|".join(["set", "placed", "operated", "used", "served", "provided", "managed", "integrated", "collected", "deployed"]) + ")"
TRACKER_BY = rf"(?i){_TRACKER}[^.;:!?]{{0,40}}?\b{_PUT}\s+by\b"
TRACKER_FROM = rf"(?i){_TRACKER}[^.;:!?]{{0,60}}?\bfrom\b"
THIRD_PARTY_SURFACE = rf"(?i)\b(?:across|on|through|via)\s+{_THIRD}\s+(?:web\s*)?{nouns('site website platform app application service')}\b"

# Phrases that introduce examples, point elsewhere, or head a page.
EXEMPLIFIER = any_of("such as", r"includ(?:e|es|ing)(?:,? (?:but|without) (?:not )?(?:limited|limitation)(?: to)?)?", "for (?:example|instance)", r"e\.?\s?g\.?", "like", "namely", "notably", "specifically", "in particular")
POINTER = any_of(
    "(?:click|tap|see|read) here",
    r"(?:(?:full|complete|current|updated) )?lists? of (?:(?:all|our|the) )?(?:third[- ]part|partner|advertis|service provider|sub[- ]?processor|compan|vendor|recipient|affiliate)\w*",
    "available (?:on|upon) request",
    "(?:can|may) be found (?:here|at|on)",
)
POLICY_CUES = "(?i)" + "|".join([
    "privacy (?:policy|notice|statement)", "personal (?:data|information)", "data (?:protection|processing|controller|subject)", _THIRD, "cookies?", "consent",
    r"we(?:\s+\w+){0,2}\s+" + r"(?:collect|use|shar\w+|disclos\w+|process|sell)\b", "your (?:rights|choices|personal)", r"opt[- ]?out", "gdpr", "ccpa", "service providers?",
    "how we (?:collect|use|share)", "information (?:we|you) (?:collect|provide|share)",
])
TERMS_TITLE = any_of("terms (?:of (?:use|service)|and conditions)", r"terms ?& ?conditions", "conditions of use", "acceptable use", "end[- ]user licen[cs]e", "eula", "user agreement")
SUBPROCESSOR_TITLE = any_of(rf"sub{_GAP}processors?", "vendor list", "service providers? list", "third[- ]party (?:providers?|vendors?)", "data processors?")
HELP_TITLE = r"(?i)(?:^|[./])(?:" + "|".join(["help", "support", "faqs?", "hc", "kb", r"knowledge[- ]?base", "articles?"]) + r")\b|\b(?:help ?cent(?:er|re)|knowledge base|frequently asked questions)\b"
PARTNERS_TITLE = any_of("our partners", "partner directory", "ad(?:vertising)? partners", "integrations?", "app directory", "marketplace")
COOKIE_TITLE = any_of("cookies?", "consent (?:manager|preferences)", "your privacy choices", "do not sell", "vendor list", "advertising partners")
VENDOR_LIST_TITLE = (
    r"(?i)\b(?:list of|the (?:following |major )?)[\w ,&/-]{0,40}?"
    rf"(?:third{_GAP}part(?:y|ies)|sub{_GAP}processors?|vendors?|recipients?|data (?:recipients?|processors?|controllers?))\b"
)
PRIVACY_TITLE = any_of("privacy", "cookies?", "data (?:protection|processing)", "gdpr", "ccpa", "do not sell", "your privacy choices", rf"sub{_GAP}processors?")
# Notices of parked domains, and marks that consent managers leave in markup.
PARKED = "(?i)" + "|".join([
    "domain (?:name )?(?:is|may be) for sale", "domain for sale", "buy this domain", "parked (?:free )?(?:domain|courtesy)", r"hugedomains|afternic|sedo\.com|dan\.com|undeveloped\.com", "godaddy auctions",
])
CMP = "(?i)" + "|".join([
    "onetrust|optanon|cookielaw|cookiepro|cookiebot|trustarc|truste|quantcast|didomi|sourcepoint|usercentrics|osano|termly|iubenda|cookieyes|axeptio|complianz",
    r"__tcfapi|__cmp|__gpp|euconsent|tcf ?v?2", r"gdpr ?consent", r"vendor[_\- ]?list", "vendors? we work with",
])

# Names in text: what makes a domain part of an address, a name the owner of something, or part of an identifier's name.
DOMAIN = r"(?i)(?<![-.\w])[a-z0-9][a-z0-9-]{1,40}\.(?:" + "|".join("com net org io ai co app dev example".split()) + r")\b"
DOMAIN_AS_ADDRESS = r"(?i)(?:https?://|www\.|@|\b(?:visit|see|at|on|via|from|under)\s+)$"
OWNER_OF = rf"(?i)^(?:'s)?\s+{nouns('setting account server api profile console')}\b|^(?:'s)?\s+data\b"
IDENTIFIER = r"\s+(?:(?:advertising|device|user)[- ])?id(?:s|fas?)?\b"
WE_USE = rf"(?i)\bwe\s+(?:\w+\s+){{0,2}}?{verb('use')}\b"
#: After a generic recipient these go on with the sentence; any other word makes it the attribute of that word.
_GOES_ON = "a an and as at by for from if in may might must of on or shall that the their they to under unless when where which who whom will with without can could except such".split()
ATTRIBUTE_OF = r"(?i)^\s+(?!(?:" + "|".join(_GOES_ON) + r")\b)[a-z-]+"

# Store labels.
NOTHING_SHARED = r"(?i)no data (?:is )?shared with third parties|doesn't share (?:any )?(?:user )?data"
MAY_SHARE = r"(?i)\bthis app may share|(?<!no )\bdata shared\b|(?<!doesn't )\bshares? (?:these |some )?(?:user )?data (?:types )?with"
TRACKS = r"(?i)data (?:used to track|linked to) you"
ASKS_HEADING = r"(?i)^(?:how|what|why|where|when|who|learn)\b[^.!?:]{0,80}$"

# Shapes of machine-readable registries.
SELLERS_JSON = r'(?i)"seller_id"\s*:|"sellers"\s*:\s*\['
TCF_GVL = r'(?i)"vendorListVersion"\s*:|"gvlSpecificationVersion"\s*:|"tcfPolicyVersion"\s*:'
VENDORS_JSON = r'(?i)"vendors"\s*:\s*[\[{]|"vendor_id"\s*:'
ADS_TXT = r"(?im)^[^\s,#][^,\n]*,[^,\n]+,\s*(?:DIRECT|RESELLER)\b"
ADS_TXT_ROW = r"(?im)^[ \t]*([a-z0-9.-]+\.[a-z]{2,})[ \t]*,[ \t]*[^,\n]+,[ \t]*(DIRECT|RESELLER)\b"
REGISTRY_NOT_NAMES = ("duns", "tag-id", "tagid", "confidential", "ssp", "dsp")
REGISTRY_KINDS = ("sellers_json", "tcf_gvl", "vendors_json", "ads_txt")

# What a link leads to, in order, by its words or its address; the roles are fixed values.
_DASH = "[-_ ]?"
LINK_ROLES = (
    ("privacy_policy", r"(?i)privacy|data protection (?:notice|statement)"),
    ("subprocessor_list", rf"(?i)sub{_DASH}processors?"),
    ("dpa", any_of("dpa", rf"data{_DASH}processing{_DASH}(?:terms|agreement|addendum)")),
    ("cookie_policy", rf"(?i)cookies?{_DASH}(?:policy|notice|statement|declaration|settings|preferences)|about cookies"),
    ("vendor_list", rf"(?i)vendors?{_DASH}lists?|lists? of (?:our )?(?:vendors|partners|recipients)|third{_DASH}party{_DASH}(?:vendors|data)|ad(?:vertising)? partners|(?:with whom|who) we share"),
    ("do_not_sell", rf"(?i)do{_DASH}not{_DASH}(?:sell|share)|opt{_DASH}out|privacy{_DASH}choices"),
    ("partners_page", rf"(?i)\b(?:our|all)[-_ ]partners\b|\bpartners?{_DASH}(?:page|directory)\b|\bintegrations?\b|\bapp{_DASH}(?:directory|marketplace)\b"),
    ("help_doc", rf"(?i)\b(?:help|support|faqs?|knowledge{_DASH}base)\b"),
)

# Document roles by use.
POLICY_ROLES = ("privacy_policy", "cookie_policy", "do_not_sell", "dpa")
POLICY_CONTEXT_ROLES = (*POLICY_ROLES, "subprocessor_list", "vendor_list")
LIST_ROLES = ("vendor_list", "subprocessor_list")
LABEL_ROLES = ("store_listing", "play_data_safety", "app_privacy")
TABLE_ROLES = (*POLICY_CONTEXT_ROLES, "partners_page")
GRAPH_ROLES = (*POLICY_ROLES, "partners_page", "help_doc")
BACKFILL_ROLES = ("vendor_list", "subprocessor_list", "do_not_sell", "partners_page")
SCRIPTED_ROLES = ("privacy_policy", "cookie_policy", "vendor_list", "subprocessor_list", "do_not_sell", "partners_page", "help_doc", "dpa")
FIRST_PARTY_URL_ROLES = ("privacy_policy", "cookie_policy", "do_not_sell")
RIGHTS_ROLES = ("do_not_sell", "privacy_policy", "cookie_policy", "dpa")
REGISTRY_ROLES = ("ads_txt", "app_ads_txt", "sellers_json", "vendors_json", "tcf_gvl")
WEB_REGISTRIES = ("ads_txt", "sellers_json", "vendors_json", "tcf_gvl")
APP_REGISTRIES = ("app_ads_txt", "sellers_json", "vendors_json", "tcf_gvl")
LISTED_ROLES = (*LIST_ROLES, *REGISTRY_ROLES)
APP_TYPES = ("play_store_app", "app_store_app")
WEB_TYPES = ("website", "data_broker")
MEDIA = ("prose", "structured", "machine_readable", "other_doc")
SPECIFICITIES = ("named", "category", "generic")

# Words of a purpose, tested as parts of the lower-cased text between blanks.
PURPOSE_CUES = {
    "services": ("necessary", "essential", "functional", "session", "login", "log in", "preferences", "payment", "deliver", "hosting", "customer support", "shipping", "provide the service", "checkout"),
    "security": ("security", "fraud", "authenticat", "abuse", "bot ", "csrf", "protect"),
    "legal": ("legal", "complian", "law ", "regulat", "court", "subpoena"),
    "advertising": ("advertis", "marketing", " ads ", "targeting", "retarget", "remarketing", "promot", "campaign", "paid placements"),
    "analytics": ("analytic", "statistic", "measur", "usage", "performance", "traffic", "research", "improv"),
}
CORE_PURPOSES, NON_CORE_PURPOSES = ("services", "security", "legal"), ("advertising", "analytics")
# Purpose numbers of the consent framework; any other number is "other".
TCF_PURPOSES = {1: "services", 2: "advertising", 3: "advertising", 4: "advertising", 7: "advertising", 8: "analytics", 9: "analytics", 5: "other", 6: "other", 10: "other"}

# Headers of tables, and words in them.
VENDOR_HEADER = rf"(?i)\b(?:{nouns('vendor provider company partner processor recipient supplier host domain organisation organization')}|sub-?processors?|third party)\b"
NAME_HEADER = rf"(?i)^{nouns('name entity service party')}$"
COOKIE_HEADER = rf"(?i)\b(?:{nouns('cookie')}|duration|lifespan|life|retention|expir\w*)\b"
PURPOSE_HEADER = rf"(?i)\b{nouns('purpose description use usage function category type reason processing')}\b"
# Words of headers and cells.
SUBPROCESSOR_WORDS = ("name", "subprocessor", "sub-processor", "vendor", "company", "entity", "purpose", "service", "processing", "location", "country", "region", "data", "category")
SUBPROCESSOR_STRONG = ("subprocessor", "sub-processor", "vendor", "company", "entity", "purpose", "processing", "service")
OWN_CELLS = ("this website", "this site", "website", "we", "us", "first party", "first-party", "own", "n/a", "none", "self", "various", "internal", "-")
# Legal forms, endings of product names, words that aren't organisations.
CORPORATE_SUFFIX = r"(?i)\b(?:inc|llc|llp|ltd|limited|plc|pty|corp|corporation|co|gmbh|ag|ab|oy|s\.?a\.?|b\.?v\.?|s\.?r\.?l\.?)\b\.?$"
CORPORATE_WORDS = ("inc", "llc", "ltd", "limited", "gmbh", "corp", "corporation", "company", "group", "plc", "holdings")
SERVICE_TAILS = ("analytics", "ads", "pixel", "sdk", "api", "connect", "platform", "cloud", "network", "beacon", "tag", "manager", "insights", "audience", "audiences", "remarketing", "metrics", "studio", "services")
LEGAL_TERMS = ("gdpr", "ccpa", "cpra", "coppa", "hipaa", "lgpd", "pipeda", "ssl", "tls", "privacy shield", "data protection authority", "european union", "eea", "eu", "usa")
DEFINED_TERMS = ("service", "services", "website", "site", "platform", "app", "application", "cookies", "policy", "agreement", "terms", "user", "users", "company", "content", "account", "data")
NOT_ACTORS = ("act", "law", "regulation", "directive", "code", "statute", "policy", "agreement", "shield", "framework")

# Addresses tried by convention.
REGISTRY_PATHS = {"web": (("ads_txt", "/ads.txt"), ("sellers_json", "/sellers.json"), ("vendors_json", "/vendors.json")), "app": (("app_ads_txt", "/app-ads.txt"), ("sellers_json", "/sellers.json"), ("vendors_json", "/vendors.json"))}
COMPANION_PATHS = (
    ("vendor_list", "/vendor-list"), ("vendor_list", "/vendors"), ("subprocessor_list", "/subprocessors"), ("subprocessor_list", "/sub-processors"),
    ("do_not_sell", "/do-not-sell"), ("partners_page", "/partners"),
)
STORE_HOSTS = ("play.google.com", "apps.apple.com", "itunes.apple.com", "support.google.com")
# Platform policies that say nothing about the site that links to them.
PLATFORM_POLICIES = (
    ("policies.google.com", "/privacy"), ("policies.google.com", "/technologies"), ("www.google.com", "/policies"), ("www.apple.com", "/legal/privacy"),
    ("www.facebook.com", "/policy"), ("www.facebook.com", "/privacy"), ("www.microsoft.com", "/privacystatement"), ("privacy.microsoft.com", "/"),
    ("automattic.com", "/privacy"), ("www.shopify.com", "/legal/privacy"),
)
