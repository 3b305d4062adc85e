"""Word lists, patterns, labels and limits. ``\\b`` and ``\\s`` are read by ``rx``."""

# Fixed values, in natural order.
AMENITIES = {
    "pool": (r"\b(pool|swimming)\b", r"\b(no\s+(pool|swimming\s+pool)|pool\s+(is\s+)?not\s+available)\b", "Pool"),
    "gym": (r"\b(gym|fitness\s*center|workout)\b", r"\b(no\s+(gym|fitness\s*center)|fitness\s*center\s+(is\s+)?not\s+available)\b", "Gym / fitness"),
    "wifi": (r"\b(wi-?fi|wireless|internet|complimentary\s+internet)\b", r"\b(no\s+(wi-?fi|wireless|internet)|wi-?fi\s+(is\s+)?not\s+available)\b", "Wi‑Fi"),
    "parking": (r"\b(parking|valet|self-?park)\b", r"\b(no\s+parking|parking\s+(is\s+)?not\s+available)\b", "Parking"),
    "spa": (r"\b(spa|sauna|steam)\b", r"\b(no\s+spa|spa\s+(is\s+)?not\s+available)\b", "Spa"),
    "breakfast": (r"\b(breakfast|continental breakfast|morning buffet)\b", r"\b(no\s+breakfast|breakfast\s+(is\s+)?not\s+available)\b", "Breakfast"),
    "accessible_rooms": (r"\b(accessible room|ada|wheelchair|mobility accessible)\b", r"\b(no\s+accessible rooms?|not\s+wheelchair\s+accessible)\b", "Accessible rooms"),
    "ev_charging": (r"\b(ev charging|electric vehicle|car charging|charging station)\b", r"\b(no\s+(ev|electric vehicle)\s+charging|ev charging\s+(is\s+)?not\s+available)\b", "EV charging"),
    "meeting_space": (r"\b(meeting room|event space|conference|banquet|wedding venue)\b", r"\b(no\s+(meeting|event|conference)\s+(rooms?|space))\b", "Meeting / event space"),
}
SERVICES = (
    ("Concierge", r"\bconcierge\b"),
    ("Room service", r"\broom\s*service\b"),
    ("Laundry", r"\blaundry\b"),
    ("Shuttle", r"\bshuttle\b"),
    ("Business center", r"\bbusiness\s*center\b"),
    ("Airport transfer", r"\bairport\s*(transfer|shuttle)\b"),
)
POLICIES = (("check_in", "Check-in time"), ("check_out", "Check-out time"), ("pet_policy", "Pet policy"), ("cancellation_policy", "Cancellation policy"), ("smoking_policy", "Smoking policy"))
PHONE = r"(?:\+?1[\s.-]?)?(?:\(\d{3}\)|\d{3})[\s.-]?\d{3}[\s.-]?\d{4}\b"
EMAIL = r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
BAD_EMAIL_PARTS = ("example.", "domain.", "yourname", "name@", "email@", "user@", "test@")
BAD_EMAIL_ENDS = (".png", ".jpg", ".jpeg", ".webp")
ROLE_MAILBOX = r"^(info|frontdesk|reservations?|booking|stay|hello|contact|sales|concierge)@"
SUFFIX = "(?:street|st|avenue|ave|road|rd|boulevard|blvd|drive|dr|lane|ln|way|court|ct|place|pl|terrace|ter|circle|cir)"
ADDRESS = rf"\b(\d{{1,6}}\s+[\w.' -]+{SUFFIX}\b[^\n]{{0,100}}?\b\d{{5}}(?:-\d{{4}})?\b)"
STREET = rf"\b\d{{1,6}}\s+[A-Za-z0-9.' -]+{SUFFIX}\b"
ZIP = r"\b\d{5}(?:-\d{4})?\b"
PLAUSIBLE_PHONE = r"^\+?[0-9\s().-]+$"
PLAUSIBLE_EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$"
PLAUSIBLE_TIME = r"\b(?:[01]?\d|2[0-3])(?::[0-5]\d)?\s*(?:AM|PM|a\.m\.|p\.m\.)?\b"
CLOCK = r"(\d{1,2}:\d{2}\s*(?:a\.?m\.?|p\.?m\.?)?|\d{1,2}\s*(?:a\.?m\.?|p\.?m\.?))\b"
CHECK_IN = r"\b(check[-\s]?in|arrival)\b[^.\n]{0,40}\b" + CLOCK
CHECK_OUT = r"\b(check[-\s]?out|departure)\b[^.\n]{0,40}\b" + CLOCK
SECTION_STOP = r"\b(check[-\s]?in|check[-\s]?out|arrival|departure|amenit|room|dining|restaurant|parking|accessibility|privacy|terms|faq|contact|location|gallery|newsletter)\b"
PET_LABEL = r"\bpet(s)?\b|\bdog(s)?\b|\bcat(s)?\b|\banimal(s)?\b"
PET_SIGNAL = r"\b(pet policy|pets? allowed|dogs? allowed|cats? allowed|service animals?|fee|deposit|\$\s?\d|per stay|per night|weight|lbs?\.?|pounds?|maximum|max|limit|restrictions?|not allowed|prohibited|non-refundable|cleaning fee)\b"
PET_DETAIL = r"\b(pet policy|pets? allowed|dogs? allowed|cats? allowed|service animals?|fee|deposit|\$\s?\d|weight|lbs?\.?|pounds?|maximum|max|limit|restrictions?|not allowed|prohibited)\b"
PET_MARKETING = r"\b(pet-friendly|pet friendly)\b"
QUESTION = r"^\s*(?:are|do|does|what|when|where|which|who|how|can|is|in)\b[^.!?]{0,180}\?\s*$"
STOCK_QUESTIONS = r"\b(?:are pets allowed|do you allow pets|what is your pet policy|what is the pet policy|what is your cancellation policy|what is the cancellation policy|what is your smoking policy|what is the smoking policy|are there restrictions for weight, height or types)\?\s*"
POLICY_PREFIX = r"^\s*(?:pet policy|cancellation policy|smoking policy)\s*[:\-]\s*"
ANSWER_PREFIX = r"^\s*(?:pet policy|cancellation policy|smoking policy|check[-\s]?in|check[-\s]?out)\s*[:\-]\s*"
CANCEL_LABEL = r"\bcancel(lation|led|ing)?\b|\brefund(s|able)?\b|\bdeposit\b"
CANCEL_SIGNAL = r"\b(cancel|refund|deposit|non-refundable|deadline|hours|days|arrival)\b"
SMOKE_LABEL = r"\bsmok(ing|e-free|ing-free)\b|\bnon[-\s]?smoking\b"
SMOKE_SIGNAL = r"\b(smoking|smoke-free|non-smoking|fee|prohibited|designated)\b"
ANSWER_SIGNAL = {
    "pet": r"\b(pet|dog|cat|animal|service animal|fee|deposit|allowed|not allowed|prohibited|weight|pounds?|lbs?)\b",
    "cancellation": r"\b(cancel|refund|deposit|non-refundable|deadline|arrival|no-show|hours|days)\b",
    "smoking": r"\b(smok|non-smoking|smoke-free|fee|prohibited|designated)\b",
}
ROOM_BULLET = r"(?m)^(?:•|-|\*|\d+\.)\s*(.{8,80})$"
SUITE_WORDS = r"\b(standard|deluxe|suite|king|queen|twin|double|ocean\s*view|city\s*view|room|studio)\b"
ROOM_NAME = r"\b(?:classic|premier|deluxe|standard|superior|executive|accessible|ada|beacon hill|city view|studio|suite|king|queen|double|twin)\b"
ROOM_NOISE = r"\b(link to larger image|image|photo|gallery|view all|book now|reserve|check availability|amenities|policy|dining|restaurant|parking|address|phone|email|calendar|journal|press|article|decor|décor|fitness|telephone|workspace|pet|feeder|coffee|bottled water|bicycles?|hydrow|tonal|market street|complimentary|on-site|in-room|audible|messages|located|larger|guest room)\b"
ROOM_PROSE = r"\b(with|including|includes?|located|larger|use of)\b"
GENERIC_RESTAURANT = r"^(restaurant|dining|our\s+dining|food\s*&\s*beverage|f\s*&\s*b|the\s+restaurant)$"
GENERIC_VENUE = r"^(restaurant|dining|bar|café|cafe|food|our kitchen|room service)$"
GENERIC_TITLE = r"^(home|welcome|official\s+site)$"
DAYS = {"Mo": "Mon", "Tu": "Tue", "We": "Wed", "Th": "Thu", "Fr": "Fri", "Sa": "Sat", "Su": "Sun"}
DINING_START = r"\b(restaurant|restaurants|dining|bistro|grill|café|cafe|bar|breakfast|lunch|dinner|menu)\b"
DINING_STOP = r"\b(pet policy|pets?|parking|valet|garage|check[-\s]?in|check[-\s]?out|cancellation|smoking|accessibility|rooms?|suites?|amenities|services|contact|location|gallery|faq)\b"
PRICE = r"(?:[$€£]\s?\d{1,4}(?:[.,]\d{2})?|\b\d{1,4}(?:[.,]\d{2})?\s?(?:USD|EUR|GBP)\b)"
DINING_KEEP = r"\b(open daily|breakfast|lunch|dinner|\d{1,2}:\d{2})\b"
MENU_NOISE = r"\b(menu|download|pdf|view|order|reserve|reservation|hours?|open|closed|restaurant|dining)\b"
MENU_REJECT = r"\b(pet|pets|dog|cat|animal|parking|valet|vehicle|oversized|guest room|per stay|per night|fee|deposit|policy|restriction|check[-\s]?in|check[-\s]?out|cancellation|smoking)\b"
FOOD = r"\b(toast|egg|omelet|pancake|waffle|salad|soup|sandwich|burger|steak|chicken|fish|salmon|pasta|pizza|taco|dessert|cake|coffee|tea|wine|beer|cocktail|breakfast|lunch|dinner|brunch|appetizer|entree|entrée|sides?)\b"
MENU_SHAPE = r"[A-Z][A-Za-z '&()]+ - [$€£]"
MENU_INLINE = r"([A-Z][A-Za-z0-9 '&().,/+-]{3,70})\s+([-–—.]?\s*)?([$€£]\s?\d{1,4}(?:[.,]\d{2})?)"
MENU_EXTRA = r"\b(add|substitute)\s+\$?\d+(?:\.\d{2})?\b"
HOURS_LINE = r"\b(?:(?:Mo|Tu|We|Th|Fr|Sa|Su)(?:-(?:Mo|Tu|We|Th|Fr|Sa|Su))?\s+)?\d{1,2}:\d{2}\s*(?:a\.?m\.?|p\.?m\.?)?\s*[-–]\s*\d{1,2}:\d{2}\s*(?:a\.?m\.?|p\.?m\.?)?(?:\s*,\s*\d{1,2}:\d{2}\s*(?:a\.?m\.?|p\.?m\.?)?\s*[-–]\s*\d{1,2}:\d{2}\s*(?:a\.?m\.?|p\.?m\.?)?)*"
OPEN_DAILY = r"\bopen\s+daily[^.\n]{0,60}"
VENUE_NAME = r"\b([A-Z][\w\s&']{1,48})\s+(?:Restaurant|Grill|Bistro|Café|Cafe|Bar)\b"
DISH_PHRASE = r"\b(?:signature|chef|dish|menu)\b[^.\n]{0,80}"
MARKETPLACE = r"\b(booking|expedia|hotels|tripadvisor|airbnb|vrbo|kayak|trivago|priceline|agoda|orbitz)\."
IDENTITY = r"\b(hotel|resort|inn|motel|lodge|lodging|bed\s*(?:and|&)\s*breakfast|guest\s*house|suites?)\b"
OPERATIONS = r"\b(guest\s*rooms?|rooms?|suites?|accommodations?|amenities|check[-\s]?in|check[-\s]?out|reservations?|book\s+(?:now|a\s+room|your\s+stay)|stay\s+with\s+us|property\s+amenities)\b"
DETAIL = r"\b(front desk|concierge|room service|parking|pet policy|cancellation policy|accessible rooms?|fitness center|pool|spa|on-site dining|complimentary wi-?fi)\b"
NOT_LODGING = r"\b(source code|repository|developer docs|api reference|software platform|case study|download app|pricing plan|careers|job openings)\b"
LINK_PRIORITY = "amenit|room|suite|accommodation|dining|restaurant|service|polic|contact|about|facilit|gallery|meet|event|spa|pool|stay|location|wedding|banquet|menu|eat|drink|faq|offer|experience"
LINK_KEY = "contact|location|about|dining|eat|menu|room|suite|amenit|polic"
SEED_PATHS = ("/rooms", "/suites", "/accommodations", "/amenities", "/dining", "/restaurants", "/restaurant", "/menu", "/services", "/policies", "/contact", "/location", "/gallery", "/meetings", "/events", "/spa", "/offers")
ASSET = r"\.(pdf|zip|xml|rss|jpg|jpeg|png|webp|gif|svg|css|js|ico)(\?|$)"
SITEMAP_ASSET = r"\.(pdf|zip|xml|jpg|jpeg|png|gif|webp|svg|css|js)(\?|$)"
PHOTO = r"\.(jpg|jpeg|png|webp|gif)(\?|$)"
NOT_PHOTO = "/(sprite|icon|logo-16)"
IMAGE_CATEGORIES = (
    ("Rooms", r"\b(room|suite|king|queen|bed|guestroom|guest room|accommodation)\b"),
    ("Dining", r"\b(restaurant|dining|breakfast|bar|bistro|cafe|menu|food|drink)\b"),
    ("Amenities", r"\b(pool|spa|fitness|gym|amenit|wellness|parking|lobby|meeting|event|conference)\b"),
    ("Property", r"\b(exterior|facade|entrance|front|building|property|hotel)\b"),
)
LODGING_TYPES = ("Hotel", "Motel", "LodgingBusiness", "Resort", "BedAndBreakfast", "Hostel")
FOOD_TYPES = ("Restaurant", "FoodEstablishment", "BarOrPub", "CafeOrCoffeeShop")
BLOCK_TAGS = ("br", "p", "div", "section", "article", "header", "footer", "nav", "aside", "main", "li", "tr", "h1", "h2", "h3", "h4")
PATHS = (
    "hotel_name", "contact.phone", "contact.email", "contact.address", *(f"amenities.{a}" for a in AMENITIES), "dining", "services",
    *(f"policies.{p}" for p, _ in POLICIES), "room_types", "images",
)
MIME = (("png", "image/png"), ("jpg", "image/jpeg"), ("jpeg", "image/jpeg"), ("webp", "image/webp"), ("gif", "image/gif"), ("svg", "image/svg+xml"))
UNREADABLE = "No crawlable HTML pages were retrieved"
UNREADABLE_PUBLIC = "The site looks like a hotel website, but its public pages could not be opened by the scraper. The site may block automated access, disallow crawling in robots.txt, require browser verification, or serve the content in a way the crawler cannot read."

# Fixed limits.
MAX_PAGES, MAX_DEPTH, MAX_SITEMAP = 90, 7, 80
VERIFY_CUT = 18_000
MAX_CONTACTS, MAX_ROOMS, MAX_VENUES, MAX_MENU = 5, 20, 12, 20
POLICY_GROW, POLICY_CUT, POLICY_LEAST, POLICY_SENTENCE = 520, 500, 18, 80
DINING_LINES, DINING_LONGEST, DINING_BLOCKS, DINING_USED = 24, 260, 10, 6
START_SCORE, SEED_SCORE, SITEMAP_SCORE = 100.0, 38.0, 45.0
