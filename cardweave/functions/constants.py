"""Fixed values that decide results: word lists, patterns, thresholds, in the order that matters."""

# Hints, tested as substrings of lower-cased text.
ADDRESS_HINTS = ["street", "st.", "st ", "road", "rd.", "avenue", "ave", "lane", "ln", "suite", "floor", "building", "block", "po box", "p.o. box", "postcode", "postal", "zip", "district", "city", "state", "province", "country", "singapore", "india", "japan", "australia", "malaysia", "hong kong", "china", "usa", "united states"]
JOB_HINTS = ["engineer", "director", "manager", "consultant", "developer", "designer", "architect", "lead", "principal", "head", "officer", "specialist", "analyst", "founder", "president", "vp", "vice president", "systems", "software", "product", "sales", "marketing", "operations", "research"]
STRONG_JOB_HINTS = ["engineer", "director", "manager", "consultant", "developer", "designer"]
COMPANY_HINTS = ["inc", "inc.", "ltd", "ltd.", "llc", "llp", "gmbh", "pty", "pte", "pvt", "corp", "co.", "company", "group", "solutions", "technologies", "systems", "labs", "studio", "consulting"]
NAME_REJECTS = ["ltd", "limited", "llp", "inc", "corp", "corporation", "company", "group", "gmbh", "pte", "s.a.", "spa"]
COMPANY_SUFFIXES = ["LIMITED", "LTD", "LLP", "INC", "CORP", "GROUP", "GMBH", "S.P.A", "PTE"]

# Last labels and tails of domains.
TLDS = "ac ad ae af ag ai al am ar as at au be bg biz br ca cat ch cn co com coop cz de dev digital edu ee es eu fi fr fund gg gov group hk id ie in info io is it jobs jp kr la lat law li me mobi museum mx name net news nl no nz online org ph pl pro pt qa ro ru sa se sg site sk shop solutions studio su tech th travel tv tw ua uk us vn work xyz za".split()
MULTI_TLDS = "co.uk com.au com.br com.cn com.hk com.my com.sg com.tw co.in co.jp co.nz co.za co.th co.id com.mx com.ar com.tr co.kr".split()

# Patterns (Java dialect).
EMAIL_SCAN = r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+"
EMAIL_FULL = r"(?i)^[a-z0-9._%+-]{1,64}@[a-z0-9.-]{2,253}$"
URL = r"(?i)\b(?:https?://|www\.)[a-z0-9.-]+(?:\.[a-z]{2,63})+(?:/[\w\-./?%&=+#~]*)?"
PHONE_LIKE = r"(?<!\w)(?:\+\d{1,3}[\s().-]*)?(?:\(?\d{1,4}\)?[\s().-]*){1,4}\d{3,4}(?:[\s().-]*\d{1,4}){0,3}(?!\w)"
HANDLE = r"(?<!\w)@[A-Za-z0-9_.]{2,30}(?!\w)"
# Regions in their rank; India's pattern equals Singapore's and is never reached.
POSTAL = [("SG", r"\b\d{6}\b"), ("IN", r"\b\d{6}\b"), ("JP", r"\b\d{3}-\d{4}\b"), ("AU", r"\b\d{4}\b"), ("UK", r"(?i)\b[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}\b"), ("US", r"\b\d{5}(?:-\d{4})?\b"), ("CA", r"(?i)\b[A-Z]\d[A-Z]\s?\d[A-Z]\d\b")]
EMAIL_SHAPE = r"(?i)[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]{1,253}\.[A-Za-z]{2,12}"
WEB_SHAPE = r"(?i)(?:https?://|www\.)[A-Za-z0-9.\-/_%?=&#@]+|[A-Za-z0-9][\w\-]*\.[A-Za-z]{2,12}(?:/[^\s]*)?"
PHONE_RUN = r"[\+\(]?\d[\d\s\-\.\(\)]{5,16}\d"
POSTAL_SHAPE = r"(?i)\b\d{4,7}\b|\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b|\b\d{3}-\d{4}\b|\b[A-Z]\d[A-Z]\s*\d[A-Z]\d\b"
SOCIAL_SHAPE = r"(?i)(?:^|[\s,|•·])(@[\w.]{2,32}|/in/[\w\-]{3,100}|linkedin\.com/in/[\w\-]+|github\.com/[\w\-]+|twitter\.com/[\w]+|x\.com/[\w]+|instagram\.com/[\w.]+)"

# Thresholds.
IOU_MIN, MIN_CONFIDENCE, SURE_CONFIDENCE = 0.58, 0.18, 0.45
QUALITY_WEIGHTS = {"name": 1.15, "company": 1.10, "email": 1.25, "phone": 1.20, "website": 0.70, "address": 0.80, "title": 0.45}
# Calling codes and their regions.
CALLING_CODES = dict(zip(*[iter("1 US 7 RU 20 EG 27 ZA 30 GR 31 NL 32 BE 33 FR 34 ES 36 HU 39 IT 40 RO 41 CH 43 AT 44 GB 45 DK 46 SE 47 NO 48 PL 49 DE 51 PE 52 MX 54 AR 55 BR 56 CL 57 CO 60 MY 61 AU 62 ID 63 PH 64 NZ 65 SG 66 TH 81 JP 82 KR 84 VN 86 CN 90 TR 91 IN 92 PK 94 LK 98 IR 212 MA 213 DZ 216 TN 218 LY 234 NG 254 KE 255 TZ 256 UG 260 ZM 263 ZW 351 PT 352 LU 353 IE 358 FI 371 LV 372 EE 380 UA 420 CZ 421 SK 852 HK 966 SA 968 OM 971 AE 972 IL 974 QA".split())] * 2, strict=True))
# Least and greatest number of digits after the code; other regions have 7 to 11.
NATIONAL_DIGITS = {"US": (10, 10), "FR": (9, 9), "GB": (9, 10), "DE": (7, 11), "AU": (9, 9), "SG": (8, 8), "JP": (9, 10), "CN": (11, 11), "IN": (10, 10), "HK": (8, 8), "AE": (8, 9)}
# Names of regions in postal patterns that calling codes know by another.
REGION_NAMES = {"UK": "GB"}
