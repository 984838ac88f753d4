"""Schemas of the tables that pass between the stages (D1 to D19); a column whose order matters is explicit."""

from __future__ import annotations

# Column names and types of the exchanged tables.
NOTES = "note_id string, subject_id string, note string"
FILTERED = "note_id string, subject_id string, text string"
PERSONAS = "note_id string, subject_id string, name string, unit_no long, physician_name string, race string, language string, dob timestamp, email string, phone string, ssn string, address string, random_name boolean"
MEMBERS = "note_id string, subject_id string, blank int, category string, value string"
SFT = "instruction string, output string, note_id string, subject_id string"
LABELED = "entry string, label int"
COMPLETIONS = "query_idx long, dataset_size long, model_size string, pii_rate float, n_epochs long, pii_type string, prompt string, value string, ll float, n_tokens int, tokens array<int>"
LL_LONG = "dataset_size long, pii_rate double, n_epochs int, pii_type string, prompt string, split string, count long, value string, ll double, n_tokens int, list_tokens array<int>, list_log_probs array<double>, ll_with_first_name double, n_tokens_with_first_name int, list_tokens_with_first_name array<int>, list_log_probs_with_first_name array<double>"
SCORES = "value string, split string, y_true int, fold_id int, score_oof_member_proba double, pred_oof_at_0p5 int"
CURVES = "budget double, recall_with_verification double, recall_without_verification double, precision_with_verification double, precision_without_verification double, fpr_population_with_verification double, fpr_population_without_verification double, fpr_extracted_with_verification double, fpr_extracted_without_verification double, tpr_extracted_with_verification double, tpr_extracted_without_verification double"
THRESHOLDS = "fold_id int, tau double, fpr double, tp long, fp long, fn long, tn long, tpr double"
