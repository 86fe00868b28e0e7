import datetime

from pyspark.sql import functions as F

from conftest import file_rows
from filemason.operators import features
from filemason.plans import actions as A
from filemason.plans import rules as R

from filemason.catalog.views import as_of
GOLDEN = {
    "Documents/Work": "Meeting_Notes_Q3_2024.txt Project_Proposal_Draft.txt employee_handbook.txt project_timeline.txt "
                      "quarterly_report_q1_2024.txt team_meeting_agenda.txt",
    "Documents/Personal": "book_recommendations.txt grocery_list.txt python_programming_notes.txt random_notes.txt "
                          "recipe_chocolate_cake.txt todo_list.txt vacation_planning_notes.txt workout_routine.txt",
    "Documents/Financial": "Budget_Analysis_Final.txt budget_2024.txt investment_portfolio_notes.txt "
                           "monthly_expenses_march.txt tax_deductions_list.txt",
    "Documents/Educational": "machine_learning_concepts.txt online_course_certificate.txt",
    "Documents/General": "data_science_resources.txt important_document.txt important_document_edited.txt",
    "System_Files/Temp": "Copy|of|Copy|of|document.txt New|Text|Document.txt Untitled.txt performance_review_template.txt",
    "_Needs_Review/Potential_Duplicates": "important_document|(1).txt important_document_copy.txt",
    "Code/Python": "script.py",
    "Other": "app_config.json data_export.csv",
    "System_Files": ".DS_Store Thumbs.db desktop.ini",
    "Images/Photos/Camera": "IMG_20240315_143022.jpg DCIM_0001.jpg",
    "Images/Screenshots": "Screenshot_2024-03-10_at_2.15.34_PM.png",
    "Images/Photos/Social_Media": "meme_funny_cat.gif profile_picture_new.png",
    "Images/General": "vacation_beach_sunset.jpeg invoice_scan.jpg diagram_architecture.svg",
    "Software/Installers": "setup_chrome_installer.exe python-3.9.7-installer.msi adobe_photoshop_trial.dmg",
    "Software/Archives": "driver_update_v2.1.zip",
    "Software/Archives/Backups": "game_save_backup.zip",
    "Software/Archives/Projects": "project_source_code.tar.gz",
    "Media/Audio/Music": "song_favorite_track.mp3",
    "Media/Audio/Podcasts": "podcast_episode_123.mp3",
    "Media/Audio/Recordings": "audio_note_meeting.wav",
    "Media/Videos/Educational": "video_tutorial_python.mp4",
    "Media/Videos/Entertainment": "movie_trailer_2024.avi",
    "Media/Videos/Work": "presentation_recording.mov",
}


def test_golden_folders(spark):
    wanted = {n.replace("|", " "): folder for folder, names in GOLDEN.items() for n in names.split()}
    files = R.classify(file_rows(spark, list(wanted)), R.default_rules(as_of()))
    got = {r["name"]: r["target_path"].removesuffix("/" + r["name"]) for r in files.collect()}
    assert got == wanted


def test_content_keywords_make_a_document_financial(spark):
    files = file_rows(spark, ["plan.txt", "plan.jpg"], text="Mortgage mortgage loan house")
    files = R.classify(features.with_keywords(files), R.default_rules(as_of(), "top_keywords"))
    assert [r["target_path"] for r in files.orderBy("seq").collect()] == ["Documents/Financial/plan.txt", "Images/General/plan.jpg"]


def test_rule_sets_are_edited_by_name(spark):
    files = file_rows(spark, ["a.txt", "temp.txt"], modified_at=[datetime.datetime(2023, 5, 1), datetime.datetime(2025, 11, 1)])
    base = R.default_rules(as_of())
    aged = base.remove("temp").add("age_first", R.by_age(as_of()), priority=0)
    got = [r["target_path"] for r in R.classify(files, aged).orderBy("seq").collect()]
    assert got == ["Archive/Old_Files/2023/a.txt", "Documents/General/temp.txt"]
    assert len(base.rules) == 17
    only = R.RuleSet(()).add("never", lambda: F.lit(None).cast("string"))
    assert R.classify(files, only).first()["target_path"] == "_Needs_Review/a.txt"


def test_plan_order_and_text(spark):
    rows = [(5, "delete", "/a/x", None, "old"), (4, "rename", "/a/r", "/a/s", ""), (3, "move", "/a/m", "/b/m", ""),
            (2, "copy", "/a/c", "/b/c", ""), (9, "create_dir", "", "/b", "")]
    plan = spark.createDataFrame(rows, "seq bigint, action_type string, source string, destination string, reason string")
    ordered = A.ordered(plan).select("action_type", A.action_text().alias("t")).collect()
    assert [r["action_type"] for r in ordered] == ["create_dir", "copy", "move", "rename", "delete"]
    assert [r["t"] for r in ordered] == ["CREATE: /b/", "COPY: /a/c", "MOVE: m → /b/m", "RENAME: /a/r", "DELETE: x (old)"]


def test_rules_need_no_shuffle(spark):
    plan = R.classify(file_rows(spark, ["a.txt"]), R.default_rules(as_of()))._jdf.queryExecution().toString()
    assert "Exchange" not in plan
