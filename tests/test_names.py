"""Free names and the entries that they mean."""

import pytest

from weftline.functions.names import TermResolver, edits, paired, words

TERMS = [(1, "net_amount", ["montant_net", "importe_neto"]), (2, "order_date", ["date_de_commande", "bestelldatum"]), (3, "passenger_count", ["nombre_de_passagers"]), (4, "warehouse_zone", ["zone_d'entrepôt"]), (5, "tax_rate", []), (6, "heart_rate", None), (7, "contract_start", ["début_de_contrat"])]
R = TermResolver(TERMS)


@pytest.mark.parametrize(
    "name,want",
    [
        ("net_amount", 1), ("Net Amount", 1), ("NET-AMOUNT (k€)", 1), ("tbl_netAmount_2023", 1), ("Montant Net*", 1), ("amount_net", 1), ("net amuont", 1), ("netamount 12", 1), ("net_amt", 1), ("ÍMPORTE NETO", 1),
        ("BestellDatum", 2), ("order_dte", 2), ("DateOrder", 2), ("pax_cnt", 3), ("paxcnt", 3), ("whse.zone", 4), ("zone d entrepot", 4), ("warehouse", 4), ("contract", 7), ("Ｎｅｔ＿Ａｍｏｕｎｔ", 1),
        ("tax_hue", 0), ("net_amuotn", 1), ("net_smpunt", 1), ("rate", 0), ("amount", 0), ("date", 0), ("order_posture", 0), ("Velvet hue", 0), ("", 0), ("???", 0), (None, 0), ("n/a", 0), ("12", 0), ("Column7", 0), ("x" * 100_000, 0), ("net", 0),
    ],
)
def test_resolve(name, want):
    assert R.resolve(name) == want


def test_ties_mean_nothing():
    assert TermResolver([(1, "ab_cd", ["same"]), (2, "ef_gh", ["same"])]).resolve("Same") == 0
    assert TermResolver([]).resolve("x") == 0


def test_words_and_edits():
    assert words("TotalÉnergieX2 [kWh]") == ["total", "energie", "x", "2"]
    assert edits("abcd", "abdc", 2) == 1 and edits("abc", "xyz", 2) == 3 and edits("kitten", "sitting", 3) == 3


def test_word_orders_and_run_together_abbreviations_of_any_number_of_words():
    r = TermResolver([(1, "useful_life", ["durée_de_vie_de_l'actif"]), (2, "mean_time_between_two_failures", [])])
    assert r.resolve("actif_l_de_vie_de_durée") == 1 and r.resolve("failures between two mean time") == 2
    assert r.resolve("mntimbettwofail") == 2


def test_token_sets():
    r = TermResolver([(1, "mean_daily_outdoor_air_temperature", []), (2, "mean_daily_indoor_air_temperature", []), (3, "a_b_c_d_e_f_g_h_i_j", [])])
    assert r.resolve("station outdoor air temperature daily mean") == 1  # ten of eleven words in common
    assert r.resolve("air temperature daily mean") == 0  # as many in common with the other
    assert r.resolve("unknown words and more") == 0 and TermResolver([(1, "tax_rate", [])]).resolve("tax hue") == 0
    assert r.resolve("mn dly outdr air tmp") == 1 and paired([[0, 1], [0], [2, 1]]) == 3 and paired([[0], [0]]) == 1
    r.resolve(" ".join("jihgfedcba") * 3)  # many words cost no permutations


def test_typing_errors_are_found_wherever_they_are():
    r = TermResolver([(1, "warehouse_zone", [])])
    text = "warehousezone"
    for k in range(len(text)):
        assert r.resolve(text[:k] + text[k + 1 :]) == 1 and r.resolve(text[:k] + "q" + text[k:]) == 1
        if k + 1 < len(text) and text[k] != text[k + 1]:
            assert r.resolve(text[:k] + text[k + 1] + text[k] + text[k + 2 :]) == 1
