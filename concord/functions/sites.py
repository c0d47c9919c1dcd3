"""Native label columns of the chest sites and how their codes are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The canonical findings, and for each site its native label columns, each before the finding that it counts for.
CANONICAL = [
    "atelectasis", "cardiomegaly", "consolidation", "edema", "enlarged_cardiomediastinum", "fracture", "lung_lesion",
    "lung_opacity", "no_finding", "pleural_effusion", "pleural_other", "pneumonia", "pneumothorax", "support_devices",
]
NATIVE = {
    "mimic": {name: name for name in CANONICAL},
    "chexpert": {name: name for name in CANONICAL},
    "vindr_cxr": {
        "Cardiomegaly": "cardiomegaly", "Pleural effusion": "pleural_effusion", "Pneumonia": "pneumonia", "Atelectasis": "atelectasis", "No finding": "no_finding", "Consolidation": "consolidation", "Edema": "edema",
        "Pneumothorax": "pneumothorax", "Pleural thickening": "pleural_other", "Lung Opacity": "lung_opacity", "Nodule/Mass": "lung_lesion", "Rib fracture": "fracture", "Clavicle fracture": "fracture",
    },
    "nih_cxr14": {
        "cardiomegaly": "cardiomegaly", "effusion": "pleural_effusion", "pneumonia": "pneumonia", "atelectasis": "atelectasis", "no_finding": "no_finding", "consolidation": "consolidation",
        "pneumothorax": "pneumothorax", "pleural_thickening": "pleural_other", "edema": "edema", "nodule": "lung_lesion", "mass": "lung_lesion",
    },
    "padchest": {
        "cardiomegaly": "cardiomegaly", "pleural_effusion": "pleural_effusion", "pneumonia": "pneumonia", "atelectasis": "atelectasis", "no_finding": "no_finding", "consolidation": "consolidation",
        "pneumothorax": "pneumothorax", "pleural_thickening": "pleural_other", "nodule_mass": "lung_lesion", "pulmonary_edema": "edema", "pacemaker": "support_devices",
    },
    "vindr_pcxr": {"No finding": "no_finding", "Pneumonia": "pneumonia"},
}
EXTENDED = {
    "vindr_cxr": {
        "Aortic enlargement": "aortic_enlargement", "Calcification": "calcification", "Emphysema": "emphysema", "Enlarged PA": "enlarged_pa", "ILD": "ild", "Infiltration": "infiltration", "Lung cavity": "lung_cavity",
        "Lung cyst": "lung_cyst", "Mediastinal shift": "mediastinal_shift", "Pulmonary fibrosis": "pulmonary_fibrosis", "Other lesion": "other_lesion", "COPD": "copd", "Lung tumor": "lung_tumor",
        "Tuberculosis": "tuberculosis", "Other diseases": "other_diseases",
    },
    "nih_cxr14": {"infiltration": "infiltration", "emphysema": "emphysema", "fibrosis": "pulmonary_fibrosis", "hernia": "hernia"},
    "padchest": {
        "pulmonary_fibrosis": "pulmonary_fibrosis", "chronic_changes": "chronic_changes", "kyphosis": "kyphosis", "sternotomy": "sternotomy", "infiltrates": "infiltrates", "scoliosis": "scoliosis", "hernia": "hernia",
        "COPD_signs": "copd_signs", "emphysema": "emphysema", "aortic_elongation": "aortic_elongation", "cavitation": "cavitation", "volume_loss": "volume_loss", "congestion": "pulmonary_congestion",
        "bronchiectasis": "bronchiectasis", "air_trapping": "air_trapping",
    },
    "vindr_pcxr": {
        "Bronchitis/Bronchiolitis": "bronchitis_bronchiolitis", "Other disease": "other_disease", "Situs inversus": "situs_inversus", "Diagphramatic hernia": "diaphragmatic_hernia", "Tuberculosis": "tuberculosis",
        "Congenital emphysema": "congenital_emphysema", "CPAM": "cpam", "Hyaline membrane disease": "hyaline_membrane_disease", "Mediastinal tumor": "mediastinal_tumor", "Lung tumor": "lung_tumor",
    },
}
#: Codes that mean absent; 1 means present everywhere, and any other code, as 3 (uncertain) at the first two sites, means unlabelled.
ABSENT = {"mimic": [0.0, 2.0], "chexpert": [0.0, 2.0]}

_SCHEMA = "site string, native string, finding string, vocabulary string, positive double, negatives array<double>"


def site_policies(spark: SparkSession, sites: list[str] | None = None, extended: bool = True) -> DataFrame:
    """The policy table (site, native, finding, vocabulary, positive, negatives) that decode_by_policy() takes."""
    rows = [
        (site, native, finding, vocabulary, 1.0, ABSENT.get(site, [0.0]))
        for vocabulary, maps in (("canonical", NATIVE), *([("extended", EXTENDED)] if extended else []))
        for site in sites or maps
        for native, finding in maps.get(site, {}).items()
    ]
    return spark.createDataFrame(rows, _SCHEMA)
