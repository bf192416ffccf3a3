"""Derived player-season features; each needs its input columns and is left out without them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.numbers import clip, ratio_or
from kestrel.functions.seasons import plays_international_cup
from kestrel.operators.columns import c, with_prefix
from kestrel.operators.windows import chronic, delta, lagged

PLAYER, SEASON, TEAM = "player", "season_year", "team"


def engineer(df: DataFrame, player: str = PLAYER, season: str = SEASON, team: str = TEAM) -> DataFrame:
    """All features over the full history (split afterwards, so that no lag stops at a split's edge)."""
    have = set(df.columns)
    needs = lambda *names: set(names) <= have
    goals, minutes, assists = c("Performance_Gls"), c("Playing Time_Min"), c("Performance_Ast")
    new = {}
    if needs("Standard_G/SoT", "Standard_SoT%"):
        new["indice_danger_tirs"] = c("Standard_G/SoT") * c("Standard_SoT%") / 100
    if needs("Performance_Fls", "Performance_Int", "Performance_TklW"):
        new["ratio_agressivite"] = ratio_or(c("Performance_Fls"), c("Performance_Int") + c("Performance_TklW"))
    if needs("Performance_Save%", "height_in_cm"):
        new["taux_arretXtaille_gardien"] = c("Performance_Save%") / 100 * c("height_in_cm")
    if needs("xg", "Performance_Gls"):
        new["efficacite_devant_but"] = ratio_or(c("xg"), goals, 9.0)
    if needs("injury_days_total"):
        new["taux_indisponibilite"] = clip(c("injury_days_total") / 365, high=1.0)
    ranks = with_prefix(df, "classement_FIFA_")
    if ranks:
        new["score_hype_nation"] = sum((c(n) * (11 - int(n.rsplit("_", 1)[1])) for n in ranks), F.lit(0))
    if needs("Performance_Gls", "Playing Time_Min"):
        new["rentabilite_buts_minutes"] = ratio_or(goals, minutes)
    if needs("contrat_jours_restants"):
        new["urgence_contractuelle"] = F.coalesce(c("contrat_jours_restants") <= 365, F.lit(False)).cast("int")
    if needs("Performance_Gls", "Playing Time_MP", "Team Success_PPM"):
        new["impact_buts_points"] = ratio_or(goals, c("Playing Time_MP")) * c("Team Success_PPM")
    if needs("Performance_CrdY", "Performance_CrdR", "Performance_2CrdY", "Playing Time_90s"):
        yellow, red, second = (c(f"Performance_{n}") for n in ("CrdY", "CrdR", "2CrdY"))
        points = (yellow - 2 * second) + 6 * (red - second) + 3 * second
        new["indiscipline_par_90"] = ratio_or(points, c("Playing Time_90s"))
    if needs("Performance_G-PK", "Performance_Gls"):
        open_play = ratio_or(c("Performance_G-PK"), goals)
        new["ratio_buts_hors_penalty"] = open_play
        new["ratio_buts_penalty"] = F.when(goals > 0, 1 - open_play).otherwise(0.0)
    positions = with_prefix(df, "pos_")
    if positions:
        new["est_polyvalent"] = sum((c(n) for n in positions), F.lit(0)) - 1
    if needs("Starts_Compl", "Playing Time_Starts"):
        new["taux_matchs_termines"] = ratio_or(c("Starts_Compl"), c("Playing Time_Starts"))
    if needs("age"):
        new |= {
            "pic_distance": c("age") - 25,
            "age_sq": c("age") * c("age"),
            "pic_age": F.coalesce(c("age").between(24, 28), F.lit(False)).cast("int"),
        }
    if needs(season, "confederation"):
        new["competition_internationale"] = plays_international_cup(c(season), c("confederation"))
    out = df.withColumns(new) if new else df
    if needs(player, season, "Playing Time_Min"):
        out = delta(out, [player], season, "Playing Time_Min", "delta_minutes_jouees")
    if needs(player, season, "xg"):
        out = delta(out, [player], season, "xg", "delta_xg")
    if needs(player, season, "injury_days_total"):
        out = lagged(out, [player], season, "taux_indisponibilite", "taux_indisponibilite_prec", False)
        out = out.fillna(0.0, ["taux_indisponibilite_prec"])
        out = chronic(out, [player], season, "taux_indisponibilite", 0.15, "fragilite_chronique")
    if needs(team, season, "Performance_Gls", "Performance_Ast"):
        teams = out.groupBy(c(team).alias("__t"), c(season).alias("__s")).agg(F.sum(goals).alias("__goals"))
        same = c(team).eqNullSafe(F.col("__t")) & c(season).eqNullSafe(F.col("__s"))
        share = ratio_or(goals + assists, F.col("__goals"))
        out = out.join(teams, same, "left").withColumn("contribution_offensive_equipe", share).drop("__t", "__s", "__goals")
    return out


