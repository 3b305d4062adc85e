"""The demo record: a constant site with its texts and confidences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitefacts.functions.vocab import AMENITIES, POLICIES

_CONTACTS = "array<struct<label:string,value:string,note:string>>"
RECORD = (
    f"struct<hotel_name:string,website:string,contact:struct<phone:string,email:string,address:string,phones:{_CONTACTS},addresses:{_CONTACTS}>,"
    f"amenities:struct<{','.join(f'{a}:boolean' for a in AMENITIES)}>,dining:array<struct<restaurant_name:string,hours:string,menu_items:array<string>>>,services:array<string>,"
    f"policies:struct<{','.join(f'{p}:string' for p, _ in POLICIES)}>,room_types:array<string>,images:array<string>,"
    "metadata:struct<scrape_timestamp:string,source_pages:array<string>,image_details:array<struct<url:string,alt:string,caption:string,category:string>>,"
    "image_probe:array<struct<url:string,bytes:bigint,format:string,width:bigint,height:bigint,error:string>>>>"
)
SITE = "demo"
#: A record is stamped by whoever asks for it, never by the clock.
AS_OF = "2026-01-01T00:00:00.000Z"

# Fixed values.
_IMAGES = ["https://images.unsplash.com/photo-1566073771259-6a8506099945", "https://images.unsplash.com/photo-1551882547-ff40c63fe5fa"]
_ADDRESS = "120 Market Street, San Francisco, CA 94105"
STRUCTURED = {
    "hotel_name": "Harbor & Pine Hotel",
    "website": "https://demo.harborpine.example",
    "contact": {
        "phone": "(415) 555-0198",
        "email": "",
        "address": _ADDRESS,
        "phones": [
            {"label": "Primary phone", "value": "(415) 555-0198", "note": "Main phone found on the demo homepage."},
            {"label": "Reservations", "value": "(415) 555-0144", "note": "Separate reservations line found near booking copy."},
        ],
        "addresses": [{"label": "Hotel address", "value": _ADDRESS, "note": "Street address found in contact section."}],
    },
    "amenities": dict.fromkeys(AMENITIES, False) | {"pool": True, "wifi": True, "breakfast": True},
    "dining": [{"restaurant_name": "Drift Kitchen", "hours": "", "menu_items": ["Smoked salmon toast", "Seasonal grain bowl"]}],
    "services": ["Concierge", "Laundry"],
    "policies": {"check_in": "3:00 PM", "check_out": "", "pet_policy": "", "cancellation_policy": "Flexible rates may be cancelled up to 48 hours before arrival.", "smoking_policy": ""},
    "room_types": ["King Room", "Two Queen Room"],
    "images": _IMAGES,
    "metadata": {
        "scrape_timestamp": AS_OF,
        "source_pages": ["https://demo.harborpine.example/", "https://demo.harborpine.example/rooms", "https://demo.harborpine.example/dining"],
        "image_details": [
            {"url": _IMAGES[0], "alt": "Hotel exterior", "caption": "Potential exterior image found on the homepage.", "category": "Property"},
            {"url": _IMAGES[1], "alt": "Guest room", "caption": "Potential guest room image found on the rooms page.", "category": "Rooms"},
        ],
        "image_probe": None,
    },
}
PAGES = [
    ("https://demo.harborpine.example/", "Harbor & Pine Hotel offers Wi-Fi, a pool, concierge service, laundry, and flexible cancellation rates."),
    ("https://demo.harborpine.example/dining", "Drift Kitchen serves smoked salmon toast and seasonal grain bowls."),
]
CONFIDENCE = {
    "hotel_name": 0.88, "contact.phone": 0.76, "contact.email": 0.0, "contact.address": 0.82, "amenities.pool": 0.72, "amenities.gym": 0.0, "amenities.wifi": 0.7, "amenities.parking": 0.2, "amenities.spa": 0.1,
    "dining": 0.55, "services": 0.55, "policies.check_in": 0.58, "policies.check_out": 0.0, "policies.pet_policy": 0.0, "policies.cancellation_policy": 0.5, "policies.smoking_policy": 0.0, "room_types": 0.5, "images": 0.65,
}


def records(spark: SparkSession, rows: dict[str, dict] | None = None) -> DataFrame:
    """``site_id, data`` of records by site; the demo record by default."""
    return spark.createDataFrame(list((rows or {SITE: STRUCTURED}).items()), f"site_id string, data {RECORD}")


def confidences(spark: SparkSession, rows: dict[str, dict] | None = None) -> DataFrame:
    """``site_id, path, confidence``."""
    found = rows or {SITE: CONFIDENCE}
    return spark.createDataFrame([(s, p, float(c)) for s, m in found.items() for p, c in m.items()], "site_id string, path string, confidence double")
