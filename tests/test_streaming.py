from test_image import populated

from mftlake.streaming.images import on_new_images


def test_every_image_is_handed_on_once(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    data = populated()[0].image()

    def handle(image, batch):
        seen.append((image.path.rpartition("/")[2], image.volumes().first()["records"]))

    for names in (["a.img", "note.txt"], ["b.img"]):
        for n in names:
            (folder / n).write_bytes(data)
        on_new_images(spark, str(folder), str(tmp_path / "check"), handle, availableNow=True).awaitTermination()
    assert seen == [("a.img", 31), ("b.img", 31)]
