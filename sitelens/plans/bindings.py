"""Parameters of the entries whose defaults name values that the test tables do not hold.

Each line: entry, the builder's parameters, and the same values in the oracle text.
"""

from sitelens.plans.registry import bind

bind("c_e01_filter_by_keyword", {"word": "view"}, {"Festival": "view"})
bind("c_x05_like_museum", {"word": "widget"}, {"museum": "widget"})
bind("c_g04_guides_salary_range", {"lo": 2000, "hi": 6000}, {"20000 AND 60000": "2000 AND 6000"})
bind("c_g05_guides_language_in_set", {"languages": ("NATION_9", "NATION_11", "NATION_6")},
     {"'English', 'French', 'Spanish'": "'NATION_9', 'NATION_11', 'NATION_6'"})
bind("c_a03_guides_salary_range", {"lo": 3000, "hi": 6000}, {"30000 AND 60000": "3000 AND 6000"})
bind("c_a04_guides_language_in", {"languages": ("NATION_9", "NATION_11", "NATION_6")},
     {"'English', 'Bangla', 'French'": "'NATION_9', 'NATION_11', 'NATION_6'"})
bind("c_a05_high_salary_or_special", {"min_salary": 5000, "word": "MIDDLE"}, {"50000": "5000", "Cultural": "MIDDLE"})
bind("c_a10_union_language_groups", {"first": "NATION_9", "second": "NATION_11"},
     {"Bangla": "NATION_9", "French": "NATION_11"})
bind("c_a11_intersect_specialization", {"a": "MIDDLE", "b": "EAST"}, {"Cultural": "MIDDLE", "History": "EAST"})
bind("c_s04_filter_by_type_and_location", {"type_": "MEDIUM", "location": "Brand#1"},
     {"Mosque": "MEDIUM", "Bagerhat": "Brand#1"})
bind("c_s05_range_search_price", {"lo": 930, "hi": 960}, {"30 AND 120": "930 AND 960"})
bind("c_s06_set_membership_in", {"types": ("MEDIUM", "PROMO")}, {"'Museum', 'Monastery', 'Ancient City'": "'MEDIUM', 'PROMO'"})
bind("c_s28_fulltext_sample", {"q": "+widget"}, {"museum": "widget"})
bind("c_v02_visitors_no_bookings", {"since": "2000-01-01"},
     {"b.visitor_id WHERE": "b.visitor_id AND b.booking_date >= TIMESTAMP '2000-01-01' WHERE"})
bind("c_s01_ddl_tables_columns", {"exact": True}, {})
bind("c_g03_guides_table_structure", {"exact": True}, {})
bind("c_v04_visitors_high_avg_rating", {"min_avg": 3.5}, {"4.5": "3.5"})
bind("b02a_visitors_name_prefix", {"prefix": "C"}, {"'A%'": "'C%'"})
bind("b02b_guides_language_like", {"word": "NATION_1"}, {"English": "NATION_1"})
bind("b07_top_rated_sites_view", {"min_avg": 3}, {"> 4": "> 3"})
bind("b11a_sites_price_between", {"lo": 910, "hi": 950}, {"100 AND 500": "910 AND 950"})
bind("b11b_guides_english_or_bangla", {"words": ("NATION_1", "NATION_2")}, {"English": "NATION_1", "Bangla": "NATION_2"})
bind("b11d_sites_at_location", {"location": "Brand#4"}, {"Dhaka": "Brand#4"})
bind("b11e_visitors_email_domain", {"domain": "0@example.com"}, {"@gmail.com": "0@example.com"})
