"""Fixed places: states, provinces, countries and cities with their coordinates."""

from __future__ import annotations

# Fixed values, as they must be for the same places to be found.
US_STATES = {
    "AL": "Alabama",
    "AK": "Alaska",
    "AZ": "Arizona",
    "AR": "Arkansas",
    "CA": "California",
    "CO": "Colorado",
    "CT": "Connecticut",
    "DE": "Delaware",
    "FL": "Florida",
    "GA": "Georgia",
    "HI": "Hawaii",
    "ID": "Idaho",
    "IL": "Illinois",
    "IN": "Indiana",
    "IA": "Iowa",
    "KS": "Kansas",
    "KY": "Kentucky",
    "LA": "Louisiana",
    "ME": "Maine",
    "MD": "Maryland",
    "MA": "Massachusetts",
    "MI": "Michigan",
    "MN": "Minnesota",
    "MS": "Mississippi",
    "MO": "Missouri",
    "MT": "Montana",
    "NE": "Nebraska",
    "NV": "Nevada",
    "NH": "New Hampshire",
    "NJ": "New Jersey",
    "NM": "New Mexico",
    "NY": "New York",
    "NC": "North Carolina",
    "ND": "North Dakota",
    "OH": "Ohio",
    "OK": "Oklahoma",
    "OR": "Oregon",
    "PA": "Pennsylvania",
    "RI": "Rhode Island",
    "SC": "South Carolina",
    "SD": "South Dakota",
    "TN": "Tennessee",
    "TX": "Texas",
    "UT": "Utah",
    "VT": "Vermont",
    "VA": "Virginia",
    "WA": "Washington",
    "WV": "West Virginia",
    "WI": "Wisconsin",
    "WY": "Wyoming",
    "DC": "District of Columbia",
}
PROVINCES = {
    "AB": "Alberta",
    "BC": "British Columbia",
    "MB": "Manitoba",
    "NB": "New Brunswick",
    "NL": "Newfoundland and Labrador",
    "NS": "Nova Scotia",
    "NT": "Northwest Territories",
    "NU": "Nunavut",
    "ON": "Ontario",
    "PE": "Prince Edward Island",
    "QC": "Quebec",
    "SK": "Saskatchewan",
    "YT": "Yukon",
}
#: Name or code in lower case to (country, code).
COUNTRIES = {
    "us": ("United States", "US"),
    "usa": ("United States", "US"),
    "united states": ("United States", "US"),
    "uk": ("United Kingdom", "GB"),
    "gb": ("United Kingdom", "GB"),
    "united kingdom": ("United Kingdom", "GB"),
    "england": ("United Kingdom", "GB"),
    "scotland": ("United Kingdom", "GB"),
    "wales": ("United Kingdom", "GB"),
    "ca": ("Canada", "CA"),
    "canada": ("Canada", "CA"),
    "au": ("Australia", "AU"),
    "australia": ("Australia", "AU"),
    "de": ("Germany", "DE"),
    "germany": ("Germany", "DE"),
    "fr": ("France", "FR"),
    "france": ("France", "FR"),
    "jp": ("Japan", "JP"),
    "japan": ("Japan", "JP"),
    "in": ("India", "IN"),
    "india": ("India", "IN"),
    "br": ("Brazil", "BR"),
    "brazil": ("Brazil", "BR"),
    "it": ("Italy", "IT"),
    "italy": ("Italy", "IT"),
    "es": ("Spain", "ES"),
    "spain": ("Spain", "ES"),
    "nl": ("Netherlands", "NL"),
    "netherlands": ("Netherlands", "NL"),
    "mx": ("Mexico", "MX"),
    "mexico": ("Mexico", "MX"),
    "sg": ("Singapore", "SG"),
    "singapore": ("Singapore", "SG"),
}
#: Key in lower case, name, state, country, code, latitude, longitude.
CITIES = [
    ("san francisco", "San Francisco", "California", "United States", "US", 37.7749, -122.4194),
    ("sf", "San Francisco", "California", "United States", "US", 37.7749, -122.4194),
    ("new york", "New York", "New York", "United States", "US", 40.7128, -74.006),
    ("nyc", "New York", "New York", "United States", "US", 40.7128, -74.006),
    ("brooklyn", "New York", "New York", "United States", "US", 40.6782, -73.9442),
    ("manhattan", "New York", "New York", "United States", "US", 40.7831, -73.9712),
    ("los angeles", "Los Angeles", "California", "United States", "US", 34.0522, -118.2437),
    ("la", "Los Angeles", "California", "United States", "US", 34.0522, -118.2437),
    ("chicago", "Chicago", "Illinois", "United States", "US", 41.8781, -87.6298),
    ("houston", "Houston", "Texas", "United States", "US", 29.7604, -95.3698),
    ("austin", "Austin", "Texas", "United States", "US", 30.2672, -97.7431),
    ("dallas", "Dallas", "Texas", "United States", "US", 32.7767, -96.797),
    ("buffalo", "Buffalo", "New York", "United States", "US", 42.8864, -78.8784),
    ("bloomington", "Bloomington", "Indiana", "United States", "US", 39.1653, -86.5264),
    ("las vegas", "Las Vegas", "Nevada", "United States", "US", 36.1699, -115.1398),
    ("vegas", "Las Vegas", "Nevada", "United States", "US", 36.1699, -115.1398),
    ("miami", "Miami", "Florida", "United States", "US", 25.7617, -80.1918),
    ("atlanta", "Atlanta", "Georgia", "United States", "US", 33.749, -84.388),
    ("new orleans", "New Orleans", "Louisiana", "United States", "US", 29.9511, -90.0715),
    ("houma", "Houma", "Louisiana", "United States", "US", 29.5958, -90.7195),
    ("seattle", "Seattle", "Washington", "United States", "US", 47.6062, -122.3321),
    ("boston", "Boston", "Massachusetts", "United States", "US", 42.3601, -71.0589),
    ("denver", "Denver", "Colorado", "United States", "US", 39.7392, -104.9903),
    ("philadelphia", "Philadelphia", "Pennsylvania", "United States", "US", 39.9526, -75.1652),
    ("philly", "Philadelphia", "Pennsylvania", "United States", "US", 39.9526, -75.1652),
    ("phoenix", "Phoenix", "Arizona", "United States", "US", 33.4484, -112.074),
    ("san diego", "San Diego", "California", "United States", "US", 32.7157, -117.1611),
    ("san jose", "San Jose", "California", "United States", "US", 37.3382, -121.8863),
    ("portland", "Portland", "Oregon", "United States", "US", 45.5152, -122.6784),
    ("detroit", "Detroit", "Michigan", "United States", "US", 42.3314, -83.0458),
    ("minneapolis", "Minneapolis", "Minnesota", "United States", "US", 44.9778, -93.265),
    ("kent", "Kent", "Washington", "United States", "US", 47.3809, -122.2348),
    ("washington", "Washington", "District of Columbia", "United States", "US", 38.9072, -77.0369),
    ("washington dc", "Washington", "District of Columbia", "United States", "US", 38.9072, -77.0369),
    ("dc", "Washington", "District of Columbia", "United States", "US", 38.9072, -77.0369),
    ("orlando", "Orlando", "Florida", "United States", "US", 28.5383, -81.3792),
    ("tampa", "Tampa", "Florida", "United States", "US", 27.9506, -82.4572),
    ("nashville", "Nashville", "Tennessee", "United States", "US", 36.1627, -86.7816),
    ("charlotte", "Charlotte", "North Carolina", "United States", "US", 35.2271, -80.8431),
    ("pittsburgh", "Pittsburgh", "Pennsylvania", "United States", "US", 40.4406, -79.9959),
    ("columbus", "Columbus", "Ohio", "United States", "US", 39.9612, -82.9988),
    ("indianapolis", "Indianapolis", "Indiana", "United States", "US", 39.7684, -86.1581),
    ("kansas city", "Kansas City", "Missouri", "United States", "US", 39.0997, -94.5786),
    ("st. louis", "St. Louis", "Missouri", "United States", "US", 38.627, -90.1994),
    ("saint louis", "St. Louis", "Missouri", "United States", "US", 38.627, -90.1994),
    ("baltimore", "Baltimore", "Maryland", "United States", "US", 39.2904, -76.6122),
    ("salt lake city", "Salt Lake City", "Utah", "United States", "US", 40.7608, -111.891),
    ("toronto", "Toronto", "Ontario", "Canada", "CA", 43.6532, -79.3832),
    ("vancouver", "Vancouver", "British Columbia", "Canada", "CA", 49.2827, -123.1207),
    ("montreal", "Montreal", "Quebec", "Canada", "CA", 45.5017, -73.5673),
    ("london", "London", None, "United Kingdom", "GB", 51.5074, -0.1278),
    ("paris", "Paris", None, "France", "FR", 48.8566, 2.3522),
    ("berlin", "Berlin", None, "Germany", "DE", 52.52, 13.405),
    ("tokyo", "Tokyo", None, "Japan", "JP", 35.6762, 139.6503),
    ("sydney", "Sydney", "New South Wales", "Australia", "AU", -33.8688, 151.2093),
    ("melbourne", "Melbourne", "Victoria", "Australia", "AU", -37.8136, 144.9631),
    ("singapore", "Singapore", None, "Singapore", "SG", 1.3521, 103.8198),
    ("mumbai", "Mumbai", "Maharashtra", "India", "IN", 19.076, 72.8777),
    ("delhi", "Delhi", "Delhi", "India", "IN", 28.6139, 77.209),
    ("new delhi", "Delhi", "Delhi", "India", "IN", 28.6139, 77.209),
    ("bengaluru", "Bengaluru", "Karnataka", "India", "IN", 12.9716, 77.5946),
    ("bangalore", "Bengaluru", "Karnataka", "India", "IN", 12.9716, 77.5946),
    ("dubai", "Dubai", None, "United Arab Emirates", "AE", 25.2048, 55.2708),
]
